"""Language identification and text statistics on Spark: training, model tables, scoring, evaluation."""

from importlib import import_module

VERSION = 1

_API = {
    "Counts": "operators.counts", "Model": "operators.model", "benchmark_report": "operators.evaluate", "build_model": "operators.model", "classify": "operators.scoring", "classify_stream": "streaming",
    "classify_top": "operators.scoring", "count_stream": "streaming", "held_out_report": "operators.evaluate", "read_corpus": "sources.text", "read_file": "sources.modelfile", "score": "operators.scoring",
    "strided_split": "operators.split", "terms": "operators.scoring", "train": "operators.model", "train_corpus": "plans.jobs", "train_counts": "operators.counts", "write_files": "sources.modelfile",
}
__all__ = ["VERSION", *_API]


def __getattr__(name: str):
    """The names of the API, each from its module when first asked for: workers import the package for less."""
    if name not in _API:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_API[name]}"), name)

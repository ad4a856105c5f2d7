"""The built-in languages and where their public corpora are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WEB_2, WEB_EN = "HuggingFaceFW/fineweb-2", "HuggingFaceFW/fineweb"
_SETS = (
    "bg:bul_Cyrl cs:ces_Latn da:dan_Latn de:deu_Latn el:ell_Grek en: es:spa_Latn et:ekk_Latn fi:fin_Latn fr:fra_Latn ga:gle_Latn hr:hrv_Latn hu:hun_Latn it:ita_Latn ja:jpn_Jpan "
    "ko:kor_Hang lt:lit_Latn lv:lvs_Latn mt:mlt_Latn nl:nld_Latn pl:pol_Latn pt:por_Latn ro:ron_Latn ru:rus_Cyrl sk:slk_Latn sl:slv_Latn sv:swe_Latn uk:ukr_Cyrl zh:cmn_Hani"
)
#: (code, dataset, prefixes), in order of their index.
LANGUAGES = [(c, WEB_2, [f"data/{s}/train/"]) if s else (c, WEB_EN, ["sample/", "data/"]) for c, _, s in (x.partition(":") for x in _SETS.split())]
SCHEMA = "lang_index int, code string, repo string, prefixes array<string>"


def resolve(requested: list[str] | None = None) -> list[str]:
    """Codes in the order asked for, repeats kept; all if none are asked for."""
    known = [c for c, _, _ in LANGUAGES]
    for code in requested or ():
        if code not in known:
            raise ValueError(f"unknown lang code: {code}")
    return list(requested) if requested else known


def languages(spark: SparkSession, requested: list[str] | None = None) -> DataFrame:
    by_code = {c: (r, p) for c, r, p in LANGUAGES}
    return spark.createDataFrame([(i, c, *by_code[c]) for i, c in enumerate(resolve(requested))], SCHEMA)


def dataset_url(repo: str, path: str) -> str:
    return f"https://huggingface.co/datasets/{repo}/resolve/main/{path}"

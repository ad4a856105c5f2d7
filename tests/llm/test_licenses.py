import math
import re
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np

from langloom.llm import licenses


def test_notices_and_cosine():
    m = licenses.Matcher(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        assert m.best(text)[0] == name and m.best(text)[1] > 0.999
    assert m.best("no such thing here")[0] is None and m.best("")[0] is None
    text = "prose before\n# Licensed under the Apache License, Version 2.0.\nmore prose " + "word " * 60 + "released under the MIT license " + "word " * 60
    spans = licenses.notices(text)
    assert text[slice(*spans[0])] == "# Licensed under the Apache License, Version 2.0." and len(spans) == 2
    assert len(text[slice(*spans[1])].split()) == 2 * licenses.AROUND + 1
    long = "x " * 200_000 + "Copyright" + " y" * 200_000
    assert len(licenses.notices(long)) == 1


def test_inheritance(spark, empty):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a/one.py", "code"), ("a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."), ("a/b/c/two.py", "code"), ("a/b/c/two.py", "code"),
        ("a/b/c/own.py", "# Licensed under the Apache License, Version 2.0."), ("top.py", None), (None, "code"), ("a/x/COPYING", "nothing of the kind"), ("a/x/three.py", ""), ("a/b/NOTICE", "All rights reserved."),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.license, r.inherited_from, r.depth) for r in licenses.inherit(licenses.scan(files)).collect()}
    assert got == {
        ("LICENSE", "MIT", None, None), ("a/one.py", "MIT", "LICENSE", 1), ("a/b/LICENSE.txt", "CC-BY-NC-4.0", None, None), ("a/b/c/two.py", "CC-BY-NC-4.0", "a/b/LICENSE.txt", 1),
        ("a/b/c/own.py", "Apache-2.0", None, None), ("top.py", "MIT", "LICENSE", 0), (None, None, None, None), ("a/x/COPYING", "MIT", "LICENSE", 2), ("a/x/three.py", "MIT", "LICENSE", 2), ("a/b/NOTICE", "Proprietary", None, None),
    }
    assert licenses.inherit(licenses.scan(empty.withColumnRenamed("note", "path"))).count() == 0


def brute_cosines(templates, text, log=False):
    """(name, cosine) of the best template, from the definition: tf-idf over words and pairs, all templates in turn."""
    split = lambda t: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())
    bag = lambda w: Counter(w) + Counter(" ".join(p) for p in zip(w, w[1:], strict=False))
    bags = [bag(split(t)) for _, t in templates]

    def vector(c):
        return {k: (1 + math.log(n) if log else n) * (1 + math.log((1 + len(bags)) / (1 + sum(k in b for b in bags)))) for k, n in c.items()}

    def cosine(a, b):
        return sum(x * b.get(k, 0.0) for k, x in a.items()) / (math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values())) or 1)

    mine = vector(bag(split(text)))
    return max(((n, cosine(mine, vector(b))) for (n, _), b in zip(templates, bags, strict=True)), key=lambda x: x[1])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    words, seen = re.compile(r"licen[sc]e|copyright|rights\s+reserved|spdx|permission\s+is\s+hereby|redistribut|public\s+domain", re.I), {}
    own = {}
    for i, r in docs.items():
        lines = [line for line in r.text.split("\n") if words.search(line)]
        for line in lines:
            seen.setdefault(line, brute_cosines(licenses.TEMPLATES, line))
        found = [seen[line] for line in lines if seen[line][1] >= 0.5]
        own[i] = max(found, key=lambda f: (f[0] != "Proprietary", f[1]), default=(None, 0.0))[0]
    low = {}
    for i in sorted(docs):
        if own[i]:
            r = docs[i]
            low.setdefault((r.source, r.lang, i // 1000), i)
    first = {}
    for i in low.values():
        s = docs[i].source
        first[s] = min(first.get(s, i), i, key=lambda j: (docs[j].lang, str(j // 1000), j))
    rows = licenses.op2(spark, d).collect()
    assert len(rows) == len(docs) and len({r.own_license for r in rows}) > 4
    for r in rows:
        doc = docs[r.doc_id]
        assert r.own_license == own[r.doc_id]
        near = low.get((doc.source, doc.lang, r.doc_id // 1000))
        far = first.get(doc.source)
        want = own[r.doc_id] or (own[near] if near is not None else own[far] if far is not None else None)
        assert r.license == want
        assert r.depth == (None if own[r.doc_id] or want is None else 0 if near is not None else 2)


def test_cosines_of_whole_texts():
    whole = licenses.Whole((*licenses.TEXTS, *licenses.license_texts()))
    texts = dict(licenses.license_texts())
    assert len(texts) > 15
    for t in (texts["ISC"], texts["MPL-2.0"][:3000], texts["Apache-2.0"] + " x y z", "some prose about software and permission", licenses.TEXTS[2][1] + " and more"):
        name, cos = brute_cosines((*licenses.TEXTS, *licenses.license_texts()), t, True)
        got = whole.best(t)
        assert got[0] == name and math.isclose(got[1], cos, abs_tol=1e-9)
    assert whole.best("") == (None, 0.0)


def test_licence_files_in_a_tree(spark, monkeypatch):
    """Whole licences as projects have them: wrapped anew, with years and names, in directories that inherit."""
    texts = dict(licenses.license_texts())
    head = "{}\n\nCopyright (c) 2019-2024, Example Project and its contributors <team@example.org>\n\n"
    rows, want = [("main.c", "int main;")], {"main.c": (None, None)}
    for n, t in texts.items():
        wrapped = head.format(n) + "\n\n".join(textwrap.fill(p, 64) for p in t.split("\n\n"))
        rows += [(f"{n}/COPYING", wrapped), (f"{n}/src/deep/a.c", "int a;"), (f"{n}/src/b.c", "")]
        want |= {f"{n}/COPYING": (n, None), f"{n}/src/deep/a.c": (n, f"{n}/COPYING"), f"{n}/src/b.c": (n, f"{n}/COPYING")}
    rows += [("GPL-3.0/src/vendor/LICENSE", head.format("x") + texts["ISC"]), ("GPL-3.0/src/vendor/c.c", "int c;"), ("readme.txt", "About us.\n" * 50 + texts["Zlib"])]
    want |= {"GPL-3.0/src/vendor/LICENSE": ("ISC", None), "GPL-3.0/src/vendor/c.c": ("ISC", "GPL-3.0/src/vendor/LICENSE"), "readme.txt": (None, None)}
    monkeypatch.setattr(licenses, "FOLDERS_A_COPY", 2)
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.inherited_from) for r in licenses.inherit(licenses.scan(files)).collect()}
    assert got == want
    rows = [("LICENSE", texts["MPL-2.0"])] + [(f"d{i}/e{i % 3}/x.c", "int x;") for i in range(40)]
    got = licenses.inherit(licenses.scan(spark.createDataFrame(rows, "path string, text string"))).collect()
    assert all((r.license, r.depth) == ("MPL-2.0", 2 if "/" in r.path else None) for r in got)


def test_installed_licence_files():
    """Real files of packages that are here; named as their projects say."""
    root = Path(np.__file__).parents[1]
    known = {"regex-": "Apache-2.0", "urllib3-": "MIT", "psutil-": "BSD-3-Clause", "xxhash-": "BSD-2-Clause", "hypothesis-": "MPL-2.0", "requests-": "Apache-2.0", "pluggy-": "MIT", "idna-": "BSD-3-Clause"}
    whole, parts = licenses.Whole((*licenses.TEXTS, *licenses.license_texts())), licenses.Matcher(licenses.TEXTS)
    seen = 0
    for start, name in known.items():
        for f in [*root.glob(f"{start}*/LICENSE*"), *root.glob(f"{start}*/licenses/LICENSE*")]:
            text = f.read_text(errors="replace")
            got, block = whole.best(text), licenses.block(text, parts)
            assert (block[0] if block[0] and block[1] > got[1] else got[0]) == name and got[1] > licenses.FILE_LEAST, f
            seen += 1
    assert seen > 3


def own(spark, *texts):
    files = spark.createDataFrame([(f"{i}/LICENSE", t) for i, t in enumerate(texts)], "path string, text string").coalesce(1)
    return [r.own_license for r in licenses.scan(files).orderBy("path").collect()]


def test_licence_texts_of_many_lines(spark):
    whole = dict(reversed(licenses.TEXTS))
    head = "Copyright (c) 2021, The Authors\nAll rights reserved.\n\n"
    texts = [head + textwrap.fill(whole[n].replace("copyright holder", "University"), 72) + "\n" for n in ("BSD-3-Clause", "BSD-2-Clause", "MIT")]
    gpl = textwrap.fill(whole["GPL-3.0"], 60) + "\n" + "The licenses for most software and other practical works are yours.\nAll rights reserved.\n"
    code = "/*\n * All rights reserved.\n *\n" + "\n".join(" * " + x for x in textwrap.wrap(whole["BSD-3-Clause"], 70)) + "\n */\n" + "int x;\n" * 3000
    assert own(spark, *texts, gpl, code, "prose\nAll rights reserved.\n") == ["BSD-3-Clause", "BSD-2-Clause", "MIT", "GPL-3.0", "BSD-3-Clause", "Proprietary"]


def test_notices_inside_long_lines_and_spdx(spark):
    few, many = "the code in this folder was written there ", "some other words of plain prose stand here " * 12
    notes = {
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "All rights reserved.": "Proprietary",
    }
    for before, after in ((few, ""), ("", few), (few, few), (many, many), (many + "a license of sorts and then " + few, many)):
        assert own(spark, *[before + n + " " + after for n in notes]) == list(notes.values())
    assert own(spark, many + many, many + "the license is somewhere " + many) == [None, None]
    assert own(spark, "# SPDX-License-Identifier: Apache-2.0", "// SPDX-License-Identifier: (MIT OR GPL-2.0)", "/* SPDX-License-Identifier: GPL-3.0-or-later */", "x SPDX-License-Identifier: ISC") == ["Apache-2.0", "MIT", "GPL-3.0", "ISC"]
    assert own(spark, "Copyright 2020 The Authors. All rights reserved.\nLicensed under the Apache License, Version 2.0.") == ["Apache-2.0"]

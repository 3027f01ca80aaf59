import math
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from liftpanel.llm.tfidf_licenses import LEAST_COSINE, NOTICE, TEMPLATES, scan
from tests.conftest import SMALL
from tests.llm.cases import CLASHES, rows_of

FILES = [
    ("a/LICENSE", "Licensed under the Apache License, Version 2.0.\nfoo bar"),
    ("a/b/x.py", "code"),
    ("a/b/c/y.py", "# Released under the MIT License.\ncode"),
    ("a/b/c/z.py", None),
    ("q/r.py", ""),
    ("LICENSE.txt", "nothing here"),
    ("a/b/c/copying", "This work is licensed under the GNU General Public License, version 3."),
    ("q/s/t.py", "copyright 2020 Some Body"),
    ("a/b/c/d/e.py", "x"),
    ("a/b/c/d/e.py", "x"),
    (None, "Released under the MIT License."),
]


def terms(text):
    return [t for t in re.split(r"[^a-z0-9.-]+|[.-]+(?=[^a-z0-9]|$)|(?:^|(?<=[^a-z0-9]))[.-]+", text.lower()) if t]


def plain(files, speaks):
    """The same by plain loops: cosines of dictionaries, folders climbed one by one."""
    texts = {}
    for path, text in files:
        if path is not None:
            texts.setdefault(path, []).append(text or "")
    notices = {p: Counter(t for x in own for t in terms("\n".join(line for line in x.split("\n") if re.search(NOTICE, line)))) for p, own in texts.items()}
    notices = {p: c for p, c in notices.items() if c}
    df, n = Counter(t for c in notices.values() for t in c), len(notices)
    weight = lambda c: {t: k * (1 + math.log((1 + n) / (1 + df[t]))) for t, k in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for path, count in notices.items():
        v, found = weight(count), []
        for name, notice in TEMPLATES:
            m = weight(Counter(terms(notice)))
            found.append((-round(sum(v[t] * m[t] for t in v.keys() & m.keys()) / (size(v) * size(m)), 6), name))
        if -min(found)[0] >= LEAST_COSINE:
            own[path] = (min(found)[1], -min(found)[0])
    folder = lambda p: p.rpartition("/")[0]
    by_folder = {}
    for path, (name, cosine) in own.items():
        if any(speaks(path, t) for t in texts[path]):
            by_folder[folder(path)] = min(by_folder.get(folder(path), (-cosine, path, name)), (-cosine, path, name))
    out = {}
    for path in texts:
        if path in own:
            out[path] = (*own[path], "own", None)
            continue
        at, out[path] = folder(path), (None, None, "none", None)
        while True:
            if at in by_folder:
                out[path] = (by_folder[at][2], -by_folder[at][0], "inherited", at)
                break
            if not at:
                break
            at = folder(at)
    return out


def test_files_in_folders(spark):
    table = spark.createDataFrame(FILES, "path string, text string")
    got = {r[0]: tuple(r[1:]) for r in scan(table).collect()}
    assert got == plain(FILES, lambda p, t: re.search(r"(?i)(^|/)(licen[sc]e|copying|notice|copyright)(\.[a-z]+)?$", p))
    assert got["a/b/x.py"][:1] + got["a/b/x.py"][2:] == ("Apache-2.0", "inherited", "a")
    assert got["a/b/c/d/e.py"][0] == "GPL-3.0" and got["a/b/c/y.py"][0] == "MIT" and got["q/r.py"][2] == "none"


def test_small_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.concat_ws("/", "source", (F.col("doc_id") % 7).cast("string"), "doc_id").alias("path"), "text")
    files = [tuple(r) for r in docs.collect()]
    got = {r[0]: tuple(r[1:]) for r in scan(docs, F.col("n_notice") > 0).collect()}
    want = plain(files, lambda p, t: re.search(NOTICE, t or ""))
    assert {p: (x[0], x[2], x[3]) for p, x in got.items()} == {p: (x[0], x[2], x[3]) for p, x in want.items()}
    assert sum(x[2] == "own" for x in got.values()) >= 3


def test_odd_tables(spark):
    table = spark.createDataFrame(FILES, "path string, text string")
    clashing = table.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in table.columns])
    assert rows_of(scan(clashing.repartition(5))) == rows_of(scan(table))
    assert scan(table.limit(0)).count() == 0
    long = spark.createDataFrame([("x/LICENSE", "word " * 50_000 + "\nReleased under the MIT License.")], "path string, text string")
    assert scan(long).first()["license"] == "MIT"


def test_notices_are_found_however_large_the_corpus(spark):
    """A fifth of the notices say 'All rights reserved.', none says 'copyright'; the table is small, then 40 times as large."""
    lines = ["All rights reserved.", *["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."]]
    for copies in (4, 160):
        files = [(f"d{i}/f{k}", line) for i in range(copies) for k, line in enumerate(lines)]
        got = {r["path"]: r["license"] for r in scan(spark.createDataFrame(files, "path string, text string"), F.lit(False)).collect()}
        assert [got[f"d0/f{k}"] for k in range(5)] == ["proprietary", "MIT", "CC-BY-4.0", "Apache-2.0", "Apache-2.0"]
        assert all(x == got[f"d0/f{p[-1]}"] for p, x in got.items())


def test_a_term_that_no_notice_has_does_not_outweigh_the_others(spark, monkeypatch):
    from liftpanel.llm import tfidf_licenses

    monkeypatch.setattr(tfidf_licenses, "TEMPLATES", [t for t in TEMPLATES if t[1] != "All rights reserved"])
    for copies in (4, 160):
        files = [(f"f{i}", "All rights reserved." if i < copies else f"Released under the MIT License {i % 4}") for i in range(5 * copies)]
        got = {r["path"]: r["license"] for r in scan(spark.createDataFrame(files, "path string, text string"), F.lit(False)).collect()}
        assert {got[f"f{i}"] for i in range(copies)} == {"proprietary"}, copies


def test_whole_texts_and_wrapped_headers(spark):
    from liftpanel.llm.tfidf_licenses import HEADERS, TEXTS

    texts = dict(TEXTS)
    owned = lambda name: texts[name].replace("Copyright (c)", "Copyright (c) 2019-2024 Some Body and others")
    files = [(f"{name}/LICENSE", owned(name)) for name in texts]
    header = textwrap.wrap(dict(HEADERS[:1])["Apache-2.0"], 70)
    code = "\n\nimport os\nlicense = os.environ\n" + "def f(x):\n    return x + 1\n" * 50
    files += [("h/a.py", "#!/usr/bin/python\n# Copyright 2020 Some Body\n#\n# " + "\n# ".join(header) + code)]
    files += [("h/b.c", "/*\n" + "\n".join(header) + "\n*/" + code), ("h/c.c", "/*\n * " + "\n * ".join(textwrap.wrap(HEADERS[2][1], 60)) + "\n */" + code)]
    files += [("h/d.txt", "word " * 300 + "\n\nLicensed under the Apache\nLicense, Version 2.0\n\n" + "word " * 300), ("MIT/src/x.py", "code")]
    for more in (1, 100):
        table = files + [(f"n{i}/f{k}", x) for i in range(more) for k, x in enumerate(["All rights reserved.", "Licensed under CC BY 4.0."])]
        got = {r["path"]: (r["license"], r["origin"]) for r in scan(spark.createDataFrame(table, "path string, text string")).collect()}
        assert {p: got[p] for p, _ in files[: len(texts)]} == {f"{name}/LICENSE": (name, "own") for name in texts}
        assert [got[f"h/{x}"][0] for x in ("a.py", "b.c", "c.c", "d.txt")] == ["Apache-2.0", "Apache-2.0", "GPL-3.0", "Apache-2.0"]
        assert got["MIT/src/x.py"] == ("MIT", "inherited")

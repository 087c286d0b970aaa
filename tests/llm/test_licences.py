import re
import textwrap

from textlab.llm import licences
from textlab.llm.licence_texts import EQUIVALENT, LICENCES, NOTICES, full_texts

MIT = dict((k, t) for k, t in reversed(LICENCES))["MIT"]


HOLDER = re.compile(
    r"(?:(?![^\W_]|©).)*(?:(?i:©|all rights reserved|\(c\) *[0-9]|(?:\(c\) *)?copyright[ \t\n\x0b\f\r,:.–—-]*"
    r"(?:©|&copy;|\(c\)|[0-9]|by\b|[\[<{]))|(?:\([cC]\) *)?Copyright[ \t\x0b\f]+"
    r"(?!(?:Act|Disclaimer|Holder|Interest|Law|Licen[cs]e|Notice|Owner|Statement)s?\b)[A-ZÀ-ÖØ-Þ])")


def slow_lines(text):
    out = []
    for line in re.split(r"\r\n|\n|\r", text or ""):
        words = [] if HOLDER.match(line) else re.findall(r"[^\W_]+", line.lower())
        joined = " ".join(words)
        for a, b in EQUIVALENT:
            joined = re.sub(rf"(?<![^ ]){a}(?![^ ])", b, joined)
        if joined:
            out.append(joined)
    return out


def test_known_texts_in_other_clothes(spark, documents):
    dressed = "© 2020 Someone\nCopyright (c) 2019, A. B.\n" + MIT.upper().replace("SUBLICENSE", "sub-licence")
    rows = [(1, MIT), (2, dressed), (3, MIT + "\nmore"), (4, None), (5, ""), (6, "Copyright 2021 X"),
            (7, "a\r\nReleased under the MIT Licence!\rlicensed under CC BY-NC 4.0\nb"), (None, MIT),
            (8, "word " * 200_000), (1, MIT), (9, "this is licensed under the MIT License.")]
    df = documents(rows, extra=True).selectExpr("*", "'z' AS licence", "0 AS digest")
    got = licences.scan_licences(df)
    assert got.columns == [*df.columns[:-2], "digest", "licence", "notices"]
    out = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [out[i].licence for i in (1, 2, 3, 4, 5, 6, 8, 9, None)] == [
        "MIT", "MIT", None, None, None, None, None, None, "MIT"]
    assert out[7].notices == "CC-BY-NC-4.0,MIT" and out[9].notices is None
    assert out[4].digest == out[5].digest == out[6].digest
    assert licences.scan_licences(df.limit(0)).count() == 0


def wrapped(text, width):
    """Paragraphs filled to a width; those with a copyright line stay."""
    return "\n\n".join(p if re.search(r"(?m)^ *Copyright [(\[]", p) else textwrap.fill(p, width)
                       for p in re.split(r"\n\s*\n", text))


def test_wrapped_texts(spark, documents):
    cases = [(name, "Copyright 2020 A\n\n" + wrapped(text, width))
             for name, text in LICENCES for width in range(60, 91)]
    lead = "provided that the above\ncopyright notice and this permission notice appear in all copies."
    isc = re.sub(r"provided that the above\s+copyright.*?copies\.", lead, dict(LICENCES)["ISC"])
    bsd = dict(LICENCES)["BSD-3-Clause"]
    cases += [("ISC", isc), ("MIT", MIT.replace("NONINFRINGEMENT", "NON-\nINFRINGEMENT")),
              ("MIT", MIT.replace("sublicense", "sub\nlicence").replace("OR COPYRIGHT", "OR\nCOPYRIGHT")),
              ("BSD-3-Clause", bsd.replace("copyright holder", "copyright\nowner")),
              ("BSD-3-Clause", bsd.replace("COPYRIGHT HOLDER OR", "\nCOPYRIGHT\nOWNER OR"))]
    cases += [("MIT", f"{line}\n{MIT}") for line in (
        "Copyright Some Company, Inc.", "(c) Copyright 2020 A", "Copyright: 2019 B", "copyright by C",
        "Copyright <YEAR> <HOLDER>", "# COPYRIGHT (C) 2001 D", "Copyright © E")]
    out = licences.scan_licences(documents([(i, text) for i, (_, text) in enumerate(cases)])).collect()
    assert [(cases[r.doc_id], r.licence) for r in out if r.licence != cases[r.doc_id][0]] == []


def test_whole_published_texts(spark, documents):
    known = full_texts()
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"} <= {n for n, _ in known}
    cases = [(name, text.replace("https:", "http:")) for name, text in known]
    cases += [(name, wrapped(text, width)) for name, text in known for width in (66, 72, 78, 84)]
    got = licences.scan_licences(documents([(i, text) for i, (_, text) in enumerate(cases)]))
    assert [cases[r.doc_id] for r in got.collect() if r.licence != cases[r.doc_id][0]] == []


def test_canonical_lines_by_brute_force(spark, documents):
    texts = [t for _, t in LICENCES] + ["Licence-licence licences", "non non commercial non-commercial",
                                         "(c) 2020 x", "(c) list item", "** All rights reserved. **",
                                         "a © b", "1 copyright", "Ünï_çode—x", "whilst https://x"]
    rows = documents(list(enumerate(texts))).select(
        "doc_id", licences.canonical_lines(__import__("pyspark").sql.functions.col("text")).alias("l"))
    for r in rows.collect():
        assert r.l == slow_lines(texts[r.doc_id])


def test_query_and_its_sql_on_wrapped_and_whole_texts(spark, documents, parquet_dir):
    import duckdb

    from checks.compare import compare
    from textlab.llm.queries import OP9_SQL, op9_licences

    texts = [wrapped(t, w) for _, t in LICENCES for w in (62, 75)] + [t for _, t in full_texts()]
    texts += [f"{line}\n{MIT}" for line in (
        "Copyright Some Company, Inc.", "Copyright Holder of it", "copyright notice", "Copyright Laws apply",
        "(c) Copyright 2020 A", "(c) list", "Copyright: 2019 B", "copyright by C", "Copyright <YEAR>", "a © b",
        "copyright\nowner", "Non\nInfringement, sub\nlicense", "Copyright  Notices", "Copyright Übung")]
    texts += [t for _, t in NOTICES] + [None, "", MIT, MIT]
    documents(list(enumerate(texts))).write.parquet(f"{parquet_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{parquet_dir}/documents.parquet/*.parquet'")
    verdict = compare(spark, con, "op9_licences", op9_licences, OP9_SQL, parquet_dir)
    assert verdict.startswith("ok"), verdict


def test_columns_of_any_name(spark, documents):
    docs = documents([(1, MIT)]).selectExpr("*", "1 AS _lines", "2 AS _hits", "3 AS row", "4 AS hits", "5 AS lines")
    out = licences.scan_licences(docs)
    assert out.columns == [*docs.columns, "digest", "licence", "notices"]
    assert tuple(out.first())[5:10] == (1, 2, 3, 4, 5) and out.first()["licence"] == "MIT"


def test_lists_have_distinct_digests(spark):
    for entries in (LICENCES, NOTICES):
        canonical = {}
        for name, text in entries:
            assert canonical.setdefault(" ".join(slow_lines(text)), name) == name


def test_no_python_in_the_plan(spark, documents):
    plan = licences.scan_licences(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

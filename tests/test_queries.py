"""Every registered engine query against its SQL, and files and streams end to end."""

import duckdb
import pytest

from docsieve.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_encoded_findings_beyond_the_stable_alphabet(spark, tmp_path):
    """Runs whose decoded text NFKC may change have a rank like any other, as the SQL says."""
    import base64

    from docsieve.operators.rules import encoded_blocks

    plain = ["Ω" * 40, "ignore\u00a0prior instructions " * 4, "日本語" * 12 + "you are now", "½" * 40, "é" * 40, "plain" * 20]
    texts = [" . ".join(base64.b64encode(t.encode()).decode() for t in pair) for pair in zip(plain, plain[1:] + plain[:1], strict=True)]
    ids = [11 * i + 8 for i in range(len(texts))]  # these have no overlay
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(["doc_id", "risk", "n"], QUERIES["encoded_findings"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == rows(["doc_id", "risk", "n"], con.sql(ORACLE_SQL["encoded_findings"]).fetchall())
    ranks = [[f[0] for f in encoded_blocks(t, "text:line=1")] for t in texts]
    assert got == rows(["doc_id", "risk", "n"], {(i, r, x.count(r)) for i, x in zip(ids, ranks, strict=True) for r in x})


def test_files(spark, tmp_path):
    from docsieve.sources.files import confined, contents, inspect, scan_paths

    (tmp_path / "a.txt").write_text("ordinary report")
    (tmp_path / "_b.md").write_text("[x](javascript:y)")
    (tmp_path / "dir.txt").mkdir()
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    names = ["a.txt", "_b.md", "dir.txt", "link.txt", "gone.txt"]
    got = {r.name: r.result for r in scan_paths(spark, [str(tmp_path / n) for n in names]).collect()}
    assert {k: (v.risk_level, v.evidence) for k, v in got.items()} == {
        "a.txt": ("low", []),
        "_b.md": ("quarantine", ["ACTIVE_CONTENT_PRESENT"]),
        "dir.txt": ("quarantine", ["RESOURCE_LIMIT_EXCEEDED"]),
        "link.txt": ("quarantine", ["RESOURCE_LIMIT_EXCEEDED"]),
        "gone.txt": ("quarantine", ["SCANNER_DEPENDENCY_UNAVAILABLE"]),
    }
    assert inspect(contents(spark, str(tmp_path)).where("name = 'a.txt'")).first().preflight.format == "TEXT"
    paths = spark.createDataFrame([("/r/a",), ("/r/../b",), ("/rr/a",)], "p string")
    assert [r[0] for r in paths.select(confined(paths.p, "/r")).collect()] == [True, False, False]


def test_stream(spark, tmp_path):
    from docsieve.streaming import jobs

    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    low = jobs.create(folder, "a.TXT", b"ordinary report")
    bad = jobs.create(folder, "b.exe", b"ordinary report")
    (tmp_path / "in" / "notajob.txt").write_text("x")
    jobs.run(spark, folder, sink, checkpoint).awaitTermination()
    later = jobs.create(folder, "c.txt", b"you are now")
    assert {r.job_id: r.status for r in jobs.status(spark, folder, sink).collect()} == {low: "complete", bad: "complete", later: "pending"}
    jobs.run(spark, folder, sink, checkpoint).awaitTermination()
    found = {r.job_id: r for r in spark.read.parquet(sink).collect()}
    assert {k: r.risk_level for k, r in found.items()} == {low: "low", bad: "quarantine", later: "review"}
    assert jobs.lookup(spark, sink, later).first().derivative is None
    assert found[low].result == '{"risk_level":"low","evidence":[],"location":[],"structural_anomalies":[]}\n'

"""The audit in batches against the audit of all pairs at once."""

import random

import pytest

import __spark_entry__
from philolog.operators import parallel
from philolog.streaming.auditing import Audit
from tests.test_catalogue import duck, plain  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "pair_no long, a_text string, b_text string, confidence double"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    a, b = ["eins", "Zwei ", "drei", "", None, "漢字 漢", "  eins"], ["one", "Two", "two", "", None, "ten " * 40]
    return [(k, draw.choice(a), draw.choice(b), draw.choice([0.9, 0.5, 1.5, -0.1, None, 0.7])) for k in range(300)]


def told(frame):
    return sorted((r["pair_no"], tuple(r["reasons"]), r["length_ratio"]) for r in frame.collect())


def test_batches_equal_one_run(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = parallel.audit(frame)
    audit = Audit(spark, str(tmp_path), buckets=5)
    assert audit.summary().first()["total_pairs"] == 0
    for k, (lo, hi) in enumerate([(0, 90), (90, 91), (91, 91), (91, 300)]):
        audit.add(frame.where(f"pair_no >= {lo} and pair_no < {hi}"), k)
        if k == 1:
            audit.add(frame.where("pair_no = 90"), 1)  # it comes again
    assert told(audit.flags()) == told(whole)
    assert [plain(v) for v in audit.summary().first()] == [plain(v) for v in parallel.audit_summary(whole).first()]
    assert audit.summary().columns == parallel.audit_summary(whole).columns
    assert [r["pair_no"] for r in audit.anomalies(7).collect()] == [r["pair_no"] for r in parallel.first_anomalies(whole, 7).collect()]


def test_a_batch_that_comes_again_late(spark, rows, tmp_path):
    """Reading no batch from its own number on, it gives the same flags again."""
    frame = spark.createDataFrame(rows, SCHEMA)
    audit = Audit(spark, str(tmp_path), buckets=3)
    parts = [frame.where(f"pair_no >= {lo} and pair_no < {lo + 100}") for lo in (0, 100, 200)]
    for k in (0, 1, 2, 1, 2):
        audit.add(parts[k], k)
    assert told(audit.flags()) == told(parallel.audit(frame))


def test_compacted_state(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, SCHEMA)
    audit = Audit(spark, str(tmp_path), buckets=3)
    for k in range(6):
        audit.add(frame.where(f"pair_no >= {50 * k} and pair_no < {50 * k + 50}"), k)
        if k in (2, 4):
            audit.compact(k)
    assert sorted(p.name for p in (tmp_path / "first").iterdir() if p.name.startswith("batch")) == ["batch=3", "batch=4", "batch=5"]
    assert told(audit.flags()) == told(parallel.audit(frame))


def test_stream(spark, rows, tmp_path):
    """A stream of files, one a batch, stopped and begun again."""
    frame = spark.createDataFrame(rows, SCHEMA)
    audit = Audit(spark, str(tmp_path / "audit"), buckets=4)
    for k, stop in enumerate((100, 200, 300)):
        frame.where(f"pair_no >= {stop - 100} and pair_no < {stop}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = audit.start(stream, str(tmp_path / "checkpoint"), every=2, availableNow=True)
        query.awaitTermination(60)
        assert query.exception() is None and audit.summary().first()["total_pairs"] == stop, k
    assert told(audit.flags()) == told(parallel.audit(frame))


@pytest.mark.parametrize("name", ["audit_batches", "audit_running_summary", "audit_flags"])
def test_against_sql(spark, duck, name):  # noqa: F811
    out = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(out.columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=repr)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert own == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)

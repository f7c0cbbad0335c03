import datetime
import glob
import os

import pytest

from fluvia.streaming import resume

START = datetime.datetime(2024, 1, 1)
KIND = "id long, ts timestamp, kind string, value double"


def row(key, hours, kind="a", value=1.0):
    return key, None if hours is None else START + datetime.timedelta(hours=hours), kind, value


def plain(rows):
    """Each key's first row counts; rows with a null key all do."""
    seen, days = set(), {}
    for key, at, kind, value in rows:
        if at is None or key in seen:
            continue
        if key is not None:
            seen.add(key)
        days.setdefault((at.strftime("%Y-%m-%d"), kind), []).append(value)
    mean = lambda v: round(sum(v) / len(v), 6) if v else None
    return {k: (len(v), mean([x for x in v if x is not None])) for k, v in days.items()}


@pytest.fixture
def landing(spark, tmp_path):
    landed, folder = f"file://{tmp_path}/landed", f"file://{tmp_path}/known"

    def land(rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(landed)

    def go():
        return resume.advance(spark, landed, folder, "ts", "kind", "value", ["id"], "2 days")

    def result():
        return {(r.day, r.kind): (r.n, r["mean"]) for r in resume.composites(spark, folder).collect()}

    return land, go, result, str(tmp_path)


FIRST = [row(1, 0), row(2, 5, "b", 3.0), row(2, 5, "b", 3.0), row(3, 30, None, None), row(None, 31), row(None, 31), row(4, None), row(5, 70, "a", 2.5)]
SECOND = [row(1, 30, "a", 9.0), row(5, 70, "a", 2.5), row(6, 26, "a", 4.0), row(None, 31), row(7, 90, "b", None)]


def test_stopped_and_restarted_equals_the_batch(landing):
    """Repeats within a file, in a later file, and a file landed twice; nulls in keys, times, kinds and values."""
    land, go, result, _ = landing
    land(FIRST)
    assert go() == {"read": 8, "late": 0}
    assert result() == plain(FIRST)
    assert go()["read"] == 0  # nothing new
    land(SECOND)
    assert go()["late"] == 0
    assert result() == plain(FIRST + SECOND)
    land([r for r in SECOND if r[0] is not None])
    go()
    assert result() == plain(FIRST + SECOND)


def test_a_batch_that_was_cut_off_counts_once(landing):
    """The part was written but the batch not committed: it runs again under its own number."""
    land, go, result, root = landing
    land(FIRST)
    go()
    before = result()
    commits = sorted(p for p in glob.glob(f"{root}/known/state/commits/*") if os.path.basename(p).isdigit())
    for path in commits:
        os.rename(path, f"{root}/{os.path.basename(path)}.lost")
        crc = f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc"
        if os.path.exists(crc):
            os.rename(crc, f"{root}/{os.path.basename(path)}.crc.lost")
    go()
    assert result() == before
    land(SECOND)
    go()
    assert result() == plain(FIRST + SECOND)


def test_late_rows_are_counted(landing):
    land, go, result, _ = landing
    land(FIRST)
    go()
    land([row(8, 21, "a", 7.0), row(9, 23, "a", 5.0)])  # the stream waits for rows from hour 22 on
    assert go()["late"] == 1
    assert result() == plain([*FIRST, row(9, 23, "a", 5.0)])


def test_nothing_landed(landing):
    land, go, result, _ = landing
    land([])
    assert go() == {"read": 0, "late": 0}

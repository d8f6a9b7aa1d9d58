"""The edition store: whole replacement, damage, folders of other names, large days, and writers that meet."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from newsprint.operators import editions
from newsprint.plans import publish
from newsprint.sources import store

DAYS = ["2024-01-01", "2024-01-02", "2024-01-03"]


def paper(spark, n=90, mark="old", days=3):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % days).cast("int"))
    return spark.range(n).select("id", F.lit(mark).alias("mark"), day.alias("edition_date"))


def marks(df):
    return sorted((str(r.edition_date), r.mark, r.n) for r in df.groupBy("edition_date", "mark").agg(F.count(F.lit(1)).alias("n")).collect())


def test_days_are_replaced_and_read_plainly_too(spark, tmp_path):
    path = f"{tmp_path}/e"
    store.write_edition(paper(spark), path)
    store.write_edition(paper(spark, 10, "new", 1), path)
    want = [("2024-01-01", "new", 10), ("2024-01-02", "old", 30), ("2024-01-03", "old", 30)]
    assert marks(store.read_editions(spark, path)) == marks(spark.read.parquet(path)) == want
    assert store.stored_days(spark, path) == DAYS and store.read_edition(spark, path, DAYS[0]).columns == ["id", "mark", "edition_date"]
    # an empty rebuild, and rows without a date, change nothing
    store.write_edition(paper(spark).limit(0), path)
    store.write_edition(paper(spark).withColumn("edition_date", F.lit(None).cast("date")), path)
    assert marks(store.read_editions(spark, path)) == want


@pytest.mark.parametrize("step", ["write", "_swap", "_forget"])
def test_a_write_cut_off_half_way(spark, tmp_path, monkeypatch, step):
    """Until the manifest is swapped the old days are read, whole; from then on the new ones."""
    path = f"{tmp_path}/e"
    store.write_edition(paper(spark), path)
    new = paper(spark, 60, "new")
    if step == "write":
        new = new.repartition(4).withColumn("mark", F.when(F.col("id") == 33, F.raise_error(F.lit("disk full")).cast("string")).otherwise(F.col("mark")))
    else:
        monkeypatch.setattr(store, step, lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(Exception, match="disk full|gone"):
        store.write_edition(new, path)
    monkeypatch.undo()
    mark, n = ("new", 20) if step == "_forget" else ("old", 30)
    assert marks(store.read_editions(spark, path)) == [(d, mark, n) for d in DAYS]
    assert [store.read_edition(spark, path, d).count() for d in DAYS] == [n] * 3
    store.sweep(spark, path)
    assert marks(spark.read.parquet(path)) == [(d, mark, n) for d in DAYS] and not (tmp_path / "e/_stage").exists()
    store.write_edition(paper(spark, 3, "last"), path)
    assert marks(spark.read.parquet(path)) == [(d, "last", 1) for d in DAYS]


def test_a_first_write_cut_off_gives_no_rows(spark, tmp_path, monkeypatch):
    path, real, left = f"{tmp_path}/e", store._Files.move, [4]

    def move(self, old, new):
        left[0] -= 1
        if not left[0]:
            raise OSError("gone")
        return real(self, old, new)

    monkeypatch.setattr(store._Files, "move", move)
    with pytest.raises(OSError, match="gone"):
        store.write_edition(paper(spark), path)
    assert spark.read.parquet(path).count() > 0 and store.read_editions(spark, path).count() == 0 and store.stored_days(spark, path) == []


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """A writer that finds its number taken makes its change to the other's manifest."""
    path = f"{tmp_path}/e"
    store.write_edition(paper(spark, 30), path)
    real, between = store._Files.move, [lambda: store.write_edition(paper(spark, 8, "other", 2).filter("id % 2 = 1"), path)]

    def move(self, old, new):
        if "_manifest" in new and between:
            between.pop()()
        return real(self, old, new)

    monkeypatch.setattr(store._Files, "move", move)
    store.write_edition(paper(spark, 5, "mine", 1), path)
    assert marks(store.read_editions(spark, path)) == [("2024-01-01", "mine", 5), ("2024-01-02", "other", 4), ("2024-01-03", "old", 10)]
    monkeypatch.setattr(store._Files, "move", lambda self, old, new: "_manifest" not in new and real(self, old, new))
    with pytest.raises(RuntimeError, match="other writers"):
        store.write_edition(paper(spark, 5, "never", 1), path)
    assert marks(store.read_edition(spark, path, DAYS[0])) == [("2024-01-01", "mine", 5)]


def test_missing_paths_and_days(spark, tmp_path):
    path = f"{tmp_path}/e"
    assert store.read_edition(spark, f"{path}/none", DAYS[0]).count() == 0 and store.stored_days(spark, path) == []
    assert store.read_editions(spark, path, schema=paper(spark).schema).columns == ["id", "mark", "edition_date"]
    assert store.drop_pruned(spark, path, DAYS[0]) == []
    store.write_edition(paper(spark), path)
    gone = store.read_edition(spark, path, "2031-05-05")
    assert gone.count() == 0 and gone.columns == ["id", "mark", "edition_date"]


def test_junk_folders_are_left_alone(spark, tmp_path):
    path = tmp_path / "e"
    store.write_edition(paper(spark), str(path))
    for name in ("edition_date=junk", "edition_date=2024-13-45", "edition_date=__HIVE_DEFAULT_PARTITION__", "notes"):
        shutil.copytree(path / "edition_date=2024-01-01", path / name)
    assert marks(store.read_editions(spark, str(path))) == [(d, "old", 30) for d in DAYS]
    assert store.read_edition(spark, str(path), "junk").count() == 0
    assert store.drop_pruned(spark, str(path), "2024-01-03", 1) == DAYS[:2]
    assert sorted(f.name for f in path.iterdir()) == ["_manifest", "_stage", "edition_date=2024-01-03", "edition_date=2024-13-45", "edition_date=__HIVE_DEFAULT_PARTITION__", "edition_date=junk", "notes"]
    assert store.stored_days(spark, str(path)) == DAYS[2:] and store.drop_pruned(spark, str(path), "2024-01-03", 1) == []


def test_days_written_by_spark_itself(spark, tmp_path):
    """A folder without a manifest is read as it lies, junk aside, and a first write takes it over."""
    path = tmp_path / "e"
    paper(spark).write.partitionBy("edition_date").parquet(str(path))
    shutil.copytree(path / "edition_date=2024-01-01", path / "edition_date=junk")
    assert marks(store.read_editions(spark, str(path))) == [(d, "old", 30) for d in DAYS]
    store.write_edition(paper(spark, 4, "new", 1), str(path))
    assert marks(store.read_editions(spark, str(path))) == [("2024-01-01", "new", 4), *((d, "old", 30) for d in DAYS[1:])]
    assert store.drop_pruned(spark, str(path), "2024-01-03", 2) == DAYS[:1]


def test_a_damaged_file_gives_no_rows(spark, tmp_path):
    path = tmp_path / "e"
    store.write_edition(paper(spark), str(path))
    for f in (path / "edition_date=2024-01-02").glob("part-*"):
        f.write_bytes(b"not parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert marks(store.read_editions(spark, str(path))) == [("2024-01-01", "old", 30), ("2024-01-03", "old", 30)]


def test_broken_documents_give_no_rows(spark, tmp_path):
    path = tmp_path / "d"
    rows = [(i, f"f{i % 5}", f"i{i}", f"l{i}", "s", None) for i in range(60)]
    items = spark.createDataFrame(rows, "row_id long, feed_id string, item_id string, link string, section string, image_url string")
    items = items.withColumns({"published_at": F.lit("2024-01-01 10:00:00").cast("timestamp"), "edition_date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("row_id") % 4).cast("int"))})
    nested = editions.edition_nest(publish.place(items, tie=("row_id",)), ["row_id"])
    store.write_documents(nested, str(path))
    assert store.read_documents(spark, str(path), nested.schema).count() == 4
    for day, text in ((1, "{ not json"), (2, "{}"), (3, json.dumps({"edition_date": "2024-01-03", "lead": None, "secondaries": None, "briefs": [], "sections": []}))):
        for f in (path / f"edition_date=2024-01-0{day}").glob("part-*"):
            f.write_text(text)
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    shutil.copytree(path / "edition_date=2024-01-04", path / "edition_date=junk")
    assert [str(r.edition_date) for r in store.read_documents(spark, str(path), nested.schema).collect()] == ["2024-01-04"]
    assert store.read_documents(spark, f"{path}/none", nested.schema).count() == 0


def test_a_large_day_is_written_by_several_tasks(spark, tmp_path):
    path = tmp_path / "e"
    hot = spark.range(0, 400_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") % 100 > 0, "2024-01-01").otherwise("2024-01-02").cast("date").alias("edition_date"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        store.write_edition(hot, str(path))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d: len(list((path / f"edition_date={d}").glob("part-*"))) for d in DAYS[:2]}
    assert files["2024-01-01"] >= 4 and files["2024-01-02"] == 1
    assert store.read_editions(spark, str(path)).count() == 400_000

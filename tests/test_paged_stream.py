"""Pages as a stream: a growing list, failed pages, a killed worker, restarts."""

import textwrap
from pathlib import Path

import pytest

from ashlar.sources import files


@pytest.fixture
def world(spark, tmp_path, monkeypatch):
    """Documents, their list, and a loader in a module of its own that dies while a mark is there."""
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "dying_loader.py").write_text(textwrap.dedent(f"""
        import os
        from ashlar.sources.files import text_page

        def load(path, page):
            if page == 5 and os.path.exists({str(tmp_path / "dies")!r}):
                os._exit(1)
            if page == 2:
                raise ValueError("a bad page")
            return text_page(path, page)
    """))
    spark.sparkContext.addPyFile(str(tmp_path / "code" / "dying_loader.py"))
    monkeypatch.syspath_prepend(str(tmp_path / "code"))
    spark.dataSource.register(files.PageSource)
    for name, pages in (("a", 7), ("b", 1), ("c", 9)):
        (tmp_path / f"{name}.txt").write_text("\f".join("" if p == 4 else f"{name}{p}" for p in range(pages)))
    return tmp_path


def add(world, *lines):
    with open(world / "list.tsv", "a") as file:
        file.write("".join(lines))


def run(spark, world, loader="dying_loader:load"):
    source = spark.readStream.format("pages").option("pagesPerTask", 2).option("loader", loader).load(str(world / "list.tsv"))
    query = source.writeStream.format("parquet").option("path", str(world / "out")).option("checkpointLocation", str(world / "ck")).trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    except Exception:  # noqa: BLE001 (the test asks for it below)
        pass
    return query.exception()


def written(spark, world):
    return sorted((Path(r.source).stem, r.page, r.method, r.text) for r in spark.read.parquet(str(world / "out")).collect())


def expected(name, pages):
    kind = {2: ("error", ""), 4: ("blank", "")}
    return [(name, p + 1, *kind.get(p, ("text", f"{name}{p}"))) for p in range(pages)]


def test_each_page_is_written_once_over_growth_death_and_restart(spark, world):
    add(world, f"{world}/a.txt\t7\n", f"{world}/b.txt\t1")  # the second line has not ended
    (world / "dies").touch()
    assert run(spark, world) is not None  # a worker dies with the batch
    (world / "dies").unlink()
    assert run(spark, world) is None
    assert written(spark, world) == expected("a", 7)
    add(world, "\n", f"{world}/none.txt\t2\n", f"{world}/c.txt\t9\n")
    assert run(spark, world) is None
    assert run(spark, world) is None  # nothing new
    got = written(spark, world)
    assert got == sorted(expected("a", 7) + expected("b", 1) + expected("c", 9) + [("none", 1, "error", ""), ("none", 2, "error", "")])


def test_offsets_cut_documents_anywhere():
    class Listed(files.PageStreamReader):
        def listed(self):
            return [("a", 7), ("empty", 0), ("b", 3)]

    reader = Listed({"path": "", "pagesPerTask": "4"})
    cut = lambda a, b: [(p.path, p.first, p.last) for p in reader.partitions({"page": a}, {"page": b})]
    assert cut(0, 10) == [("a", 0, 4), ("a", 4, 7), ("b", 0, 3)] and reader.latestOffset() == {"page": 10}
    for a in range(11):
        for b in range(a, 11):
            assert [(p, n) for p, f, u in cut(a, b) for n in range(f, u)] == ([("a", n) for n in range(7)] + [("b", n) for n in range(3)])[a:b]

import threading

import pytest
from sparkloom.sources import versions
from sparkloom.sources.versions import Conflict, Unready, Versioned

SCHEMA = "repo string, id long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return Versioned(spark, f"file://{tmp_path}/t")


def frame(spark, *found):
    return spark.createDataFrame(found, SCHEMA)


START = (("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 4, "n"))


def test_readers_pin_a_version(spark, table):
    one = table.create(frame(spark, *START), ["repo"], revision="r1")
    pinned = table.read(one)
    two = table.replace(one, frame(spark, ("a", 0, "")), frame(spark, ("a", 9, "new")), revision="r2")
    three = table.delete(two, frame(spark, (None, 0, "")))
    assert rows(pinned) == rows(table.read(table.version(1))) == sorted(START, key=str)
    assert rows(table.read(two)) == sorted([("a", 9, "new"), ("b", 3, "z"), (None, 4, "n")], key=str)
    assert rows(table.read(table.version())) == [("a", 9, "new"), ("b", 3, "z")]
    assert table.numbers() == [1, 2, 3] and three.count() == 2 and table.version(2) == two


def test_one_of_two_writers_loses(spark, table):
    base = table.create(frame(spark, *START), ["repo"])
    won, lost = [], []

    def write(name):
        try:
            won.append((name, table.replace(base, frame(spark, ("b", 0, "")), frame(spark, ("b", 5, name)))))
        except Conflict:
            lost.append(name)

    writers = [threading.Thread(target=write, args=(n,)) for n in ("p", "q", "r")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and len(lost) == 2
    assert [r for r in rows(table.read(table.version())) if r[0] == "b"] == [("b", 5, won[0][0])]
    again = table.replace(table.version(), frame(spark, ("b", 0, "")), frame(spark, ("b", 6, lost[0])))  # on the new base
    assert again.number == 3 and ("b", 6, lost[0]) in rows(table.read(again))


def test_a_write_that_breaks_off_is_not_seen(spark, table, monkeypatch):
    base = table.create(frame(spark, *START), ["repo"])

    def broken(self, version):
        raise OSError("the writer is lost")

    with monkeypatch.context() as m:
        m.setattr(versions.Versioned, "_commit", broken)
        with pytest.raises(OSError):
            table.replace(base, frame(spark, ("a", 0, "")), frame(spark, ("a", 8, "w")))
    assert table.numbers() == [1] and rows(table.read(table.version())) == sorted(START, key=str)
    after = table.delete(base, frame(spark, ("a", 0, "")))
    assert rows(table.read(after)) == sorted(START[2:], key=str)
    assert table.vacuum(keep=1) >= 2 and rows(table.read(table.version())) == sorted(START[2:], key=str)
    with pytest.raises(Unready):
        table.version(1)


def test_a_writer_lost_after_its_claim_does_not_block_the_table(spark, table, monkeypatch):
    base = table.create(frame(spark, *START), ["repo"])
    files, claim = table._files(f"{table.folder}/versions/_{2:012d}.claim")
    files.create(claim, False).close()
    with pytest.raises(Conflict):
        table.delete(base, frame(spark, ("a", 0, "")))
    monkeypatch.setattr(versions, "STALE", -1)
    assert table.delete(base, frame(spark, ("a", 0, ""))).number == 2 and table.numbers() == [1, 2]


def test_only_touched_buckets_are_written(spark, table):
    many = frame(spark, *[(f"r{i}", i, "t") for i in range(60)])
    base = table.create(many, ["repo"])
    after = table.upsert(base, frame(spark, ("r7", 7, "u")))
    changed = {b for b in base.folders if base.folders[b] != after.folders.get(b)}
    assert len(changed) == 1 and after.count() == 60
    assert ("r7", 7, "u") in rows(table.read(after)) and ("r7", 7, "t") not in rows(table.read(after))


def test_conditions_on_a_version(spark, table):
    with pytest.raises(Unready):
        table.version()
    empty = table.create(frame(spark), ["repo"], revision="r0")
    assert rows(table.read(empty)) == []
    full = table.upsert(empty, frame(spark, *START), revision="r1")
    assert table.read(full, least=4, revision="r1").count() == 4
    for asked in ({"least": 5}, {"revision": "r0"}, {"state": "READY"}):
        with pytest.raises(Unready):
            table.read(full, **asked)

"""The splittable scan of a JSON array against a parser that sees the whole text, in splits of any size."""

import json
import random

import pyarrow as pa
import pytest

from ledgerloom.sources import array_state as A
from ledgerloom.sources import ingest as I
from ledgerloom.sources.sinks import write_json_arrays


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 5)
    if kind == 0:
        return r.choice([None, True, False])
    if kind == 1:
        return r.randrange(-5, 1000)
    if kind in (2, 3, 4):
        return "".join(r.choice(['a', ',', '"', "\\", "]", "[", "{", "}", " ", "é", "\n", "/"]) for _ in range(r.randrange(9)))
    if kind == 5:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {f"k{i}": value(r, depth + 1) for i in range(r.randrange(4))}


def scanned(spark, path):
    rows = I.scan_json_array(spark, str(path)).selectExpr("src_pos", "to_json(raw) as j").collect()
    return [json.loads(x.j) for x in sorted(rows, key=lambda x: x.src_pos)], sorted(x.src_pos for x in rows)


@pytest.mark.parametrize("indent", [None, 1])
def test_any_array_in_many_ranges(spark, tmp_path, small_splits, indent):
    r = random.Random(11)
    for n in (0, 1, 160):
        items = [value(r) for _ in range(n)]
        path = tmp_path / f"a{n}.json"
        path.write_text(" \n" + json.dumps(items, indent=indent, ensure_ascii=False) + "\n ")
        got, places = scanned(spark, path)
        assert got == items and places == list(range(n))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10


@pytest.mark.parametrize(
    "text,message",
    [
        ('{"not": ["an", "array"]}', "not a JSON array"),
        ("12", "not a JSON array"),
        ("", "not a JSON array"),
        ("  \n", "not a JSON array"),
        ("[{broken", "MALFORMED"),
        ("[1,2", "MALFORMED"),
        ("[1,2,", "MALFORMED"),
        ("[1,]", "MALFORMED"),
        ("[1,,2]", "MALFORMED"),
        ("[1] 2", "MALFORMED"),
        ("[1],[2]", "MALFORMED"),
        ('["a,b]', "MALFORMED"),
        ('[{"a": 1}, {"b"}]', "MALFORMED"),
    ],
)
def test_hard_failures(spark, tmp_path, text, message):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match=message):
        I.scan_json_array(spark, str(path)).collect()


def test_arrays_written_and_read_back(spark, tmp_path, small_splits):
    rows = spark.createDataFrame([(i, f"r{i}, [x]", None if i % 3 else '"q"\\') for i in range(200)], "pos long, a string, b string")
    write_json_arrays(rows.repartition(5), str(tmp_path / "feed"), "pos")
    got, places = scanned(spark, tmp_path / "feed")
    want = [{k: v for k, v in (("a", x.a), ("b", x.b)) if v is not None} for x in rows.orderBy("pos").collect()]
    assert got == want and len(set(places)) == 200


def test_text_between_commas_is_never_sorted_or_windowed(spark, tmp_path, monkeypatch):
    """A byte range holds millions of such texts: what handles them may not buffer a range."""
    plans, real = {}, I.stage

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(I, "stage", seen)
    (tmp_path / "a.json").write_text(json.dumps([{"a": k, "b": ",]}"} for k in range(50)]))
    assert I.scan_json_array(spark, str(tmp_path / "a.json")).count() == 50
    of_chunks = [p for p in plans.values() if "MapInArrow" in p]
    assert len(of_chunks) == 2
    first, second = sorted(of_chunks, key=lambda p: "Join" in p)
    assert not any(word in first for word in ("Window", "Sort", "Aggregate"))
    # the second read is joined with one row for each range
    assert "strategy=broadcast" in second


def test_state_is_carried_from_batch_to_batch():
    """Ranges cut anywhere, read in batches of any size, give the elements of the whole."""
    rng = random.Random(3)
    wild = ['a,b', '\\"', "\\\\", "[,]", "{", "}", 'x\\", y', "ü,€", "", ",", "\\\\\\\""]
    for _ in range(60):
        records = [{w: rng.choice(wild), "n": [k, {"m": rng.choice(wild)}]} for k, w in enumerate(rng.choices("abc", k=rng.randint(1, 12)))]
        texts = json.dumps(records, ensure_ascii=rng.random() < 0.5).split(",")
        cuts = sorted(rng.sample(range(len(texts) + 1), min(len(texts), rng.randint(0, 3))))
        blocks = [sum(c <= i for c in cuts) for i in range(len(texts))]
        size = rng.randint(1, 9)

        def batches(state=None):
            for at in range(0, len(texts), size):
                rows = [
                    {"value": v, "path": "p", "block": b} | ({"begin": state[b][0], "base": state[b][1]} if state else {})
                    for v, b in zip(texts[at : at + size], blocks[at : at + size])
                ]
                yield pa.RecordBatch.from_pylist(rows)

        state, inside, depth = {}, 0, 0
        for r in (r for b in A.ranges(batches()) for r in b.to_pylist()):
            state[r["block"]] = (inside, depth)
            depth += r["depth1"] if inside else r["depth0"]
            inside = (inside + r["quotes"]) % 2
        assert (inside, depth) == (0, 0)
        found, first = [], 0
        pieces = [r for b in A.elements(batches(state)) for r in b.to_pylist()]
        parts = {}
        for r in pieces:
            if r["value"] is not None:
                parts.setdefault(first + r["k"], []).append(r["value"])
            if not r["ends"]:
                first += r["k"]
        found = [",".join(parts[k]) for k in sorted(parts)]
        assert json.loads(",".join(found)) == records
        assert [json.loads(x.removeprefix("[") if k == 0 else x) for k, x in enumerate(found[:-1])] == records[:-1]

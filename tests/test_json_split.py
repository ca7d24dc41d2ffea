"""One JSON document in many tasks: the same rows as one task, whatever the byte ranges."""

import json
import random

import pytest

from scoreloom.sources import dumps, tables
from scoreloom.sources import json_split as js
from scoreloom.sources.json_split import JsonDocuments, passed

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture(params=[2500, 1 << 27])
def ranges(spark, request):
    before = [spark.conf.get(k) for k in SIZES]
    for k in SIZES:
        spark.conf.set(k, str(request.param))
    yield request.param
    for k, v in zip(SIZES, before, strict=True):
        spark.conf.set(k, v)


STRINGS = ["plain", "", "a } b { c ] d [", 'quote " and \\" more', "back\\slash\\", "line\nbreak\ttab", "ünï \U0001f600 }", "{\"x\": [1]}", "x" * 700]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(STRINGS)
    if kind < 4:
        return rng.choice([1, -2.5, None, True])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["k", "samples", "a}b"]): value(rng, depth + 1) for _ in range(rng.randrange(3))}


def record(rng, i):
    return {"id": i, "response": rng.choice(STRINGS), "more": value(rng), "nested": {"deep": {"er": value(rng)}}}


def cut_at(text, cuts):
    """What the ranges that begin at the fragments ``cuts`` give, put together as the tables are."""
    pieces = text.split("}")
    ranges = [pieces[a:b] for a, b in zip([0, *cuts], [*cuts, len(pieces)], strict=True)]
    inside, depth, key, begin, out, parts = False, 0, None, None, [], {}
    top = text.strip()[:1]
    for number, own in enumerate(ranges):
        cutter = js._Cutter(top, inside, depth)
        for piece in own:
            cutter.add(piece)
            inside, deeper = passed(piece, inside)
            depth += deeper
        cutter.finish()
        last = key
        for kind, own_key, value in cutter.rows:
            name = key if own_key is None else own_key
            if kind == js.WHOLE:
                out.append((name, value))
            elif kind == js.BEGIN:
                begin, parts[number, name] = (number, name), [value]
            elif kind in (js.MIDDLE, js.END):
                parts[begin].append(value)
                if kind == js.END:
                    out.append((begin[1], "".join(parts[begin])))
            elif kind == js.LAST:
                last = own_key
        key = last
    return [(k, json.loads(v)) for k, v in out if k != ""]


@pytest.mark.parametrize("seed", range(30))
def test_any_cut_gives_the_same_records(seed):
    rng = random.Random(seed)
    rows = [record(rng, i) for i in range(8)]
    style = rng.choice([{}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")}])
    meta = {"inner": {"samples": [{"response": "no } [{"}], "x": {"y": {"z": 1}}}, "list": [1, [2]]}
    listed, keyed = json.dumps(rows, **style), json.dumps({"meta": meta, "samples": rows, "after": {"q": [{"r": {}}]}, "data": rows[:2]}, **style)
    for _ in range(20):
        n = listed.count("}")
        got = cut_at(listed, sorted(rng.sample(range(1, n), rng.randint(0, n - 1))))
        assert got == [(None, r) for r in rows]
        n = keyed.count("}")
        got = cut_at(keyed, sorted(rng.sample(range(1, n), rng.randint(0, n - 1))))
        assert [r for k, r in got if k == "samples"] == rows and [r for k, r in got if k == "data"] == rows[:2]
        assert {k for k, _ in got} <= {"samples", "data", "meta", "after"}


def test_array_of_objects(spark, tmp_path, ranges):
    rng = random.Random(ranges)
    rows = [record(rng, i) for i in range(60)]
    for k, style in enumerate(({"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")})):
        path = tmp_path / f"rows{k}.json"
        path.write_text(json.dumps(rows, **style), encoding="utf-8")
        got = JsonDocuments(spark, str(path)).records().collect()
        assert sorted((json.loads(r["value"]) for r in got), key=lambda r: r["id"]) == rows
        df = tables.read_tables(spark, [str(path)], schema="id long, response string")
        assert {(r["id"], r["response"]) for r in df.collect()} == {(r["id"], r["response"]) for r in rows}
    if ranges < 10**6:
        assert JsonDocuments(spark, str(path)).fragments.rdd.getNumPartitions() > 4


def test_schema_is_inferred_and_odd_documents_are_read(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": 7, "name": "only"}')
    (tmp_path / "none.json").write_text(" [ ]\n")
    (tmp_path / "two.json").write_text('[{"id": 1, "tags": ["x"]}, {"id": 2}]')
    assert [tuple(r) for r in tables.read_tables(spark, [str(tmp_path / "one.json")]).collect()] == [(7, "only", 0)]
    assert tables.read_tables(spark, [str(tmp_path / "none.json")], schema="id long").collect() == []
    rows = tables.read_tables(spark, [str(tmp_path / "two.json"), str(tmp_path / "one.json")]).collect()
    assert sorted((r["id"], r["name"], r["source_no"]) for r in rows) == [(1, None, 0), (2, None, 0), (7, "only", 1)]


def plain_dump(document):
    out = []
    for doc in document if isinstance(document, list) else [document]:
        items = next((doc[k] for k in dumps.PAYLOAD_KEYS if isinstance(doc.get(k), list)), [doc])
        for r in items:
            text = next((r[k] for k in dumps.RESPONSE_KEYS if isinstance(r.get(k), str) and r[k].strip(" ")), None)
            if text is not None:
                out.append((text, r.get("sample_id")))
    return sorted(out, key=repr)


def test_dumps_under_payload_keys(spark, tmp_path, ranges):
    rng = random.Random(ranges)
    rows = [{"sample_id": f"s{i}", "response": rng.choice(STRINGS[:5]), "more": value(rng)} for i in range(60)]
    meta = {"note": "samples: [ {", "inner": {"samples": [{"response": "not this one"}], "x": {"y": {"response": "nor this"}}}}
    documents = {
        "samples": {"meta": meta, "samples": rows, "after": {"z": [{"response": "no"}]}},
        "two": {"data": [{"response": "later key", "sample_id": "d"}], "generations": rows[:7], "tail": "}"},
        "empty": {"samples": [], "data": rows[:3]},
        "list": rows,
        "single": {"response": "one record", "sample_id": "q", "meta": {"a": [1]}},
        "wrapped": [{"samples": rows[:4]}, {"response": "own", "sample_id": "w"}],
    }
    for name, document in documents.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(document, indent=None if name == "two" else 1))
        got = [(r["response"], r["sample_id"]) for r in dumps.read_dump(spark, str(path)).collect()]
        assert sorted(got, key=repr) == plain_dump(document), name


def test_state_after_a_fragment():
    assert passed('[{"a": 1', False) == (False, 1) and passed('"b": "x { ', False) == (True, 0)
    assert passed(' y" , "z": [2]', True) == (False, -1) and passed('still \\" inside', True) == (True, 0)

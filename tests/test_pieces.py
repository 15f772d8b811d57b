"""Files beyond the limit, cut at arbitrary bytes, against the same files read whole."""

import gzip
import json
import random

import pytest

from trailspark.sources import pieces, text
from trailspark.sources.events import load_events, parse_events

NASTY = ['}],[{', '\\', '"', '\\"', '}{', '[[', 'é\U0001f600', 'a\nb', '', '\\\\"}', ',']


@pytest.fixture(params=[300, 3000])
def small_splits(spark, request):
    settings = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def some_events(seed, many):
    rng = random.Random(seed)
    for i in range(many):
        more = {"actor_location": {"country_code": rng.choice(NASTY), "deep": [{"x": [1, {}]}, []]}} if rng.random() < 0.5 else {}
        yield {"@timestamp": 1736899200000 + i, "action": rng.choice(NASTY), "actor": f"a{i}", "org": rng.choice(NASTY), **more}


def layouts(events):
    compact = json.dumps(events, separators=(",", ":"), ensure_ascii=False)
    yield "one_line.json", compact
    yield "pretty.json", " \n" + json.dumps(events, indent=2) + "\n\n"
    yield "spaced.json", "[ " + " ,\n ".join(json.dumps(e) for e in events) + " ]"
    yield "lines.json", "".join(json.dumps(e) + "\n" for e in events)
    yield "no_last_break.log", "\r\n\n".join(json.dumps(e) for e in events)


def as_rows(loaded):
    names = ("date_jst", "action", "actor", "org", "_source_file")
    return sorted(tuple(row[n] for n in names) for row in loaded.events.collect())


def test_any_layout_gives_the_same_rows_in_pieces(spark, tmp_path, small_splits):
    events = list(some_events(1, 20))
    for name, content in layouts(events):
        (tmp_path / name).write_bytes(content.encode())
    (tmp_path / "small.json").write_text(json.dumps(events[:1]))
    whole, pieces = load_events(spark, str(tmp_path)), load_events(spark, str(tmp_path), max_bytes=500)
    assert as_rows(pieces) == as_rows(whole) and len(as_rows(whole)) == 5 * 20 + 1
    assert pieces.rejects.count() == whole.rejects.count() == 0
    array = str(tmp_path / "one_line.json")
    assert as_rows(load_events(spark, array, "array", max_bytes=10_000)) == as_rows(load_events(spark, array, "array"))


def test_one_line_is_read_by_several_tasks(spark, tmp_path, small_splits):
    (tmp_path / "x.json").write_text(json.dumps(list(some_events(2, 60))))
    reader = spark.read.text(str(tmp_path), lineSep="}")
    assert reader.rdd.getNumPartitions() > 4


def test_other_elements_and_faults(spark, tmp_path, small_splits):
    contents = {
        "mixed.json": '[1,"}]", {"actor":"m1","timestamp":1736899200}, null ,[{"a":1}],{"actor":"m2","timestamp":1736899200},7]',
        "truncated.json": '[{"actor":"t1","timestamp":1736899200},{"actor":"t2","timestamp":1736899200},{"actor":"t3"',
        "broken_line.json": '{"actor":"b1","timestamp":1736899200}\n{"actor":"b2" "x"\n{"actor":"b3","timestamp":1736899200}}\n{"actor":"b4","timestamp":1736899200}',
    }
    for name, content in contents.items():
        (tmp_path / name).write_text(content)
    result = parse_events(text.raw_records(spark, str(tmp_path), max_bytes=60))
    assert sorted(row.actor for row in result.events.collect()) == ["b1", "b4", "m1", "m2", "t1", "t2"]
    rejects = {}
    for row in result.rejects.collect():
        rejects.setdefault(row["_source_file"], []).append(row.raw)
    assert sorted(rejects.pop("mixed.json")) == sorted(["1", "}]", "null", '[{"a":1}]', "7"])
    assert len(rejects.pop("broken_line.json")) == 2
    assert rejects.pop("truncated.json") == ['[{"actor":"t3"'] and not rejects


def test_a_record_beyond_the_limit_is_rejected_alone(spark, tmp_path):
    long = json.dumps({"actor": "long", "timestamp": 1736899200, "note": "x" * 5000})
    short = json.dumps({"actor": "short", "timestamp": 1736899200})
    (tmp_path / "array.json").write_text(f"[{short},{long},{short}]")
    (tmp_path / "lines.txt").write_text(f"{short}\n{long}\n{short}\n")
    result = load_events(spark, str(tmp_path), max_bytes=1000)
    assert [row.actor for row in result.events.collect()] == ["short"] * 4
    assert sorted((row["_source_file"], row.raw, row.reject_reason) for row in result.rejects.collect()) == [
        ("array.json", None, "file_too_large"), ("lines.txt", None, "file_too_large"),
    ]


def test_compressed_files_of_any_layout(spark, tmp_path):
    events = list(some_events(3, 30))
    for name, content in layouts(events):
        with gzip.open(tmp_path / f"{name}.gz", "wb") as out:
            out.write(content.encode())
    with gzip.open(tmp_path / "named.ndjson.gz", "wb") as out:
        out.write("".join(json.dumps(e) + "\n" for e in events).encode())
    for name, content in (("none.json.gz", " [ ]\n"), ("blank.json.gz", " \n"), ("numbers.json.gz", "[" + "1," * 30 + "2]")):
        with gzip.open(tmp_path / name, "wb") as out:
            out.write(content.encode())
    result = load_events(spark, str(tmp_path))
    assert len(as_rows(result)) == 6 * 30
    assert [row["_source_file"] for row in result.rejects.collect()] == ["numbers.json.gz"] * 31


def test_cuts_within_chunks_of_two_fragments_and_parts_of_seven_characters(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(pieces, "_CHUNK_BITS", 1)
    monkeypatch.setattr(pieces, "_PART", 7)
    events = list(some_events(4, 12))
    for name, content in layouts(events):
        (tmp_path / name).write_bytes(content.encode())
    (tmp_path / "truncated.json").write_text('[{"actor":"t1","timestamp":1736899200},{"actor":"t2","timestamp":1736899200},{"actor":"t3"')
    whole, loaded = load_events(spark, str(tmp_path)), load_events(spark, str(tmp_path), max_bytes=500)
    assert as_rows(whole) == as_rows(loaded) and len(as_rows(whole)) == 5 * 12
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.json").write_text((tmp_path / "truncated.json").read_text())
    cut = load_events(spark, str(tmp_path / "cut"), max_bytes=60)
    assert sorted(row.actor for row in cut.events.collect()) == ["t1", "t2"]
    assert [row.raw for row in cut.rejects.collect()] == ['[{"actor":"t3"']


def test_thousands_of_fragments_are_one_row_of_carried_state(spark, tmp_path, monkeypatch):
    scratch = tmp_path / "scratch"
    monkeypatch.setattr(pieces, "scratch_path", lambda spark, name: str(scratch / name))
    events = [{"@timestamp": 1736899200000 + i, "actor": f"a{i}", "actor_location": {"x": "}],[{"}} for i in range(3000)]
    (tmp_path / "x.json").write_text(json.dumps(events))
    assert load_events(spark, str(tmp_path / "x.json"), max_bytes=1000).events.count() == 3000
    stored = [spark.read.parquet(str(path)).count() for path in scratch.iterdir()]
    assert stored and max(stored) <= 9000 // 1000

import io
import json
import math
import wave

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus
from corpusmill.plans import pipelines
from corpusmill.sources import readers, writers
from corpusmill.streaming import monitors


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_numbered_sentences(spark, tmp_path):
    p = write(tmp_path / "s.txt", "1,আমি যাই।\n\n২. তুমি যাও।\nplain english\n4, ক\nবাহ রে!\n")
    got = [(r.id, r.text) for r in readers.numbered_sentences(spark, p).orderBy("pos").collect()]
    assert got == [("12k_00001", "আমি যাই।"), ("12k_00003", "তুমি যাও।"), ("12k_00006", "বাহ রে!")]


def test_json_sentences(spark, tmp_path):
    lines = [{"id": "a", "sentence": "আমি যাই।", "style": "s"}, {"sentence": "তুমি যাও।"}, {"id": "c"}, {"sentence": None}]
    p = write(tmp_path / "s.jsonl", "\n".join([json.dumps(lines[0], ensure_ascii=False), "{bad", "", *[json.dumps(x, ensure_ascii=False) for x in lines[1:]]]))
    got = [(r.id, r.text, r.style) for r in readers.json_sentences(spark, p).orderBy("pos").collect()]
    assert got == [("a", "আমি যাই।", "s"), ("4", "তুমি যাও।", "unknown")]


def test_prompts_round_trip(spark, tmp_path):
    p = write(tmp_path / "p.csv", 'prompt_id,text\r\n00001,"ক, খ"\r\n00002,গ\r\n')
    rows = readers.load_prompts(spark, p)
    assert [tuple(r) for r in rows.collect()] == [("00001", "sentence", "ক, খ", "pending"), ("00002", "sentence", "গ", "pending")]
    writers.write_prompts(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, readers.load_prompts(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, rows.collect()))
    writers.write_prompts(rows.limit(0), str(tmp_path / "out"))
    assert readers.load_prompts(spark, str(tmp_path / "out")).count() == 2
    assert readers.first_existing(spark, str(tmp_path / "none"), p) == p and readers.first_existing(spark, str(tmp_path / "none")) is None
    assert readers.prompt_sentences(spark, p).count() == 2


def test_metadata_merge(spark, tmp_path):
    row = {"speaker_id": "s", "prompt_id": "1", "filename": "a.wav", "accepted": True}
    write(tmp_path / "m" / "x.jsonl", "\n".join(json.dumps(x) for x in (row, row, row | {"prompt_id": "2"})))
    write(tmp_path / "m" / "a.json", json.dumps(row))
    write(tmp_path / "m" / "b.json", json.dumps(row | {"prompt_id": "3"}, indent=1))
    assert sorted(r.prompt_id for r in readers.load_metadata(spark, str(tmp_path / "m")).collect()) == ["1", "1", "2", "3"]
    writers.append_metadata(readers.load_metadata(spark, str(tmp_path / "m")), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def wav(samples, rate=8000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"".join(int(s * 32767).to_bytes(2, "little", signed=True) if width == 2 else bytes([int(s * 127 + 128)]) for s in samples))
    return out.getvalue()


def test_recordings(spark, tmp_path):
    tone = [0.3 * math.sin(i / 5) for i in range(8000)]
    write(tmp_path / "a" / "one.wav", wav(tone))
    write(tmp_path / "a" / "two.WAV", wav(tone, width=1))
    write(tmp_path / "a" / "three.wav", wav(tone, channels=2))
    write(tmp_path / "a" / "bad.wav", b"RIFFxxxx")
    write(tmp_path / "a" / "note.txt", "no")
    files = readers.audio_files(spark, str(tmp_path / "a"))
    info = {r.path.rsplit("/", 1)[1]: r for r in readers.audio_info(files).collect()}
    assert set(info) == {"one.wav", "two.WAV", "three.wav", "bad.wav"}
    assert (info["one.wav"].bits, info["one.wav"].duration, info["two.WAV"].bits, info["three.wav"].channels, info["bad.wav"].duration) == (16, 1.0, 8, 2, None)
    got = {r.path.rsplit("/", 1)[1]: r for r in pipelines.check_recordings(spark, str(tmp_path / "a")).collect()}
    assert got["one.wav"].rms_db == pytest.approx(20 * math.log10(0.3 / math.sqrt(2)), abs=0.05) and got["bad.wav"].passed is None


def test_config():
    base = {"a": 1, "b": {"c": (1, 2)}}
    assert readers.load_config('{"b": {"c": [3]}}', base) == {"a": 1, "b": {"c": [3]}}
    with pytest.raises(TypeError):
        readers.load_config('{"x": 1}', base)
    assert readers.load_config(readers.save_config(base), base) == {"a": 1, "b": {"c": [1, 2]}}


def test_curate_writes_five_outputs(spark, tmp_path):
    a = readers.numbered_sentences(spark, write(tmp_path / "s.txt", "1,আমি যাই।\n2,আমি  যাই।\n3,তুমি কি যাও?\n4,বাহ রে বাহ!\n"))
    b = readers.json_sentences(spark, write(tmp_path / "s.jsonl", json.dumps({"sentence": "আমিযাই।", "style": "x"}, ensure_ascii=False)))
    best = pipelines.curate([a, b], str(tmp_path / "out"), k=3)
    assert [r.position for r in best.orderBy("position").collect()] == [1, 2, 3]
    assert {r.source for r in best.collect()} == {"12k"}
    out = lambda x: str(tmp_path / "out" / x)
    assert spark.read.text(out("sentences")).count() == 3
    meta = readers.read_csv(spark, out("metadata")).orderBy("id").collect()
    assert [r.id for r in meta] == ["00001", "00002", "00003"] and len(meta[0]) == 8
    assert spark.read.json(out("training")).where("size(has_conjuncts) >= 0").count() == 3
    assert readers.load_prompts(spark, out("prompts")).where("status = 'pending'").count() == 3
    assert spark.read.text(out("report")).count() > 5


def test_prepare(spark, tmp_path):
    meta = spark.createDataFrame([(f"{i}.wav", "আমি যাই") for i in range(20)], "filename string, text string")
    files = spark.createDataFrame([(f"{i}.wav",) for i in range(20)], "name string")
    got = pipelines.prepare(meta, files, "/w", str(tmp_path / "out"))
    assert {r[0]: r[1] for r in got.groupBy("split").count().collect()} == {"train": 18, "val": 1, "test": 1}
    assert spark.read.text(str(tmp_path / "out/filelists/train")).first()[0].startswith("/w/")
    assert got.first().value.endswith("|আমি যাই|a m i   dʒ a i")
    pipelines.register_functions(spark)
    assert spark.sql("select bn_spoken('৩')").first()[0] == "তিন"


def test_templates_and_prompts(spark):
    forms = spark.createDataFrame([("{a} {b} {a2}", ["a", "b"]), ("{b}!", ["b"]), ("x", [])], "template string, slots array<string>")
    words = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r"), ("b", "r")], "slot string, word string")
    assert sorted(r.text for r in corpus.fill_templates(forms, words).collect()) == ["p r {a2}", "q r {a2}", "r!", "x"]
    rows = corpus.prompt_catalogue(spark, {"vowel": ["অ"], "consonant": ["ক", "খ"], "matra": ["া"], "word": ["w"], "carrier": ["say {}"]}).collect()
    assert [(r.prompt_id, r.type, r.text) for r in rows] == [("00001", "vowel", "অ"), ("00002", "consonant", "ক"), ("00003", "consonant", "খ"), ("00004", "consonant_matra", "কা"), ("00005", "consonant_matra", "খা"), ("00006", "word", "w"), ("00007", "carrier", "say w")]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "log", str(tmp_path / "view")
    rows = [{"prompt_id": "1", "filename": "a", "accepted": False, "duration": 1.5, "timestamp": "2024-01-01T00:00:00"}, {"prompt_id": "1", "filename": "b", "accepted": True, "duration": 2.0, "timestamp": "2024-01-01T00:10:00"}]
    write(src / "x.json", "\n".join(json.dumps(r) for r in rows))
    stream = monitors.metadata_stream(spark, str(src))
    q = monitors.latest_status(stream).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("latest").collect()] == [("1", "b", True)]
    w = monitors.recordings_per_window(stream).writeStream.format("memory").queryName("wins").outputMode("complete").option("checkpointLocation", out + "2").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert [(r.recordings, r.accepted, r.seconds) for r in spark.table("wins").collect()] == [(2, 1, 3.5)]
    spark.createDataFrame(pd.DataFrame({"run": [1] * 12, "step": range(12), "value": [1.0] * 12})).write.parquet(str(tmp_path / "runs"))
    runs = spark.readStream.schema("run long, step long, value double").parquet(str(tmp_path / "runs"))
    e = monitors.early_stopping_stream(runs).writeStream.format("memory").queryName("stops").outputMode("update").option("checkpointLocation", out + "3").trigger(availableNow=True).start()
    e.awaitTermination(60)
    assert [(r.counter, r.stopped) for r in spark.table("stops").collect()] == [(11, True)]


def test_every_query_has_stable_columns(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q)
    assert e.entry(spark).where(F.col("quality_score") < 10).count() == 0

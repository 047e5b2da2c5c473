import datetime as dt
import io
import random
import shutil
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import inkloom.__main__ as main
from inkloom.operators import clock, fuzzy, images, scoring, transcribe, views, voting
from inkloom.archive import Archive
from inkloom.sources import files, sinks, store
from inkloom.sources.schemas import FRAMES
from inkloom.streaming.ingest import watch


def test_align():
    ref = ["Lieve Vader, Moeder en Han,", "Hier is dan mijn eerste teken van leven.", "schrijven."]
    hyp = [ref[0], "EXTRA LINE", ref[1][:-1], ref[2]]
    assert voting.align(ref, hyp) == [0, 2, 3]
    assert voting.align([], ["a"]) == [] and voting.align(["a"], []) == [None]


def _plain_align(ref, hyp, least=45.0):
    """Alignment by the whole table of likenesses."""
    n, m = len(ref), len(hyp)
    like = [[x if (x := fuzzy.indel_ratio(a, b)) >= least else 0.0 for b in hyp] for a in ref]
    best = {}
    for i in range(n + 1):
        for j in range(m + 1):
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + like[i - 1][j - 1]) if i and j else 0.0
    out, i, j = [None] * n, n, m
    while i and j:
        if like[i - 1][j - 1] > 0 and best[i, j] == best[i - 1, j - 1] + like[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out[i] = j
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out


def test_align_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        ref = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8))]
        hyp = [x for r in ref if rng.random() < 0.8 for x in ([r[1:] + "x"] if rng.random() < 0.3 else [r, "new"] if rng.random() < 0.1 else [r])]
        assert voting.align(ref, hyp) == _plain_align(ref, hyp)


def _rows(page, readings, engine="local"):
    return [(page, engine, "m", "v", "x", k, i + 1, t, "high", None) for k, x in enumerate(readings) for i, t in enumerate(x)]


def test_vote_page(spark):
    r = [["15 Maart 1945.", "Lieve Vader, Moeder en Han,"], ["15 Maart 1945.", "Lieve Vader, Moeder en Hans,"], ["15 Maart 1945", "Lieve Vader, Moeder en Han,"]]
    good = "Ik hoop dat jullie het goed maakt"
    outvoted = [["Wim v. Ollosel"], ["Wim v. Alloosel"], ["Wim v. Alloosel"]]
    rows = _rows("p", r) + _rows("q", [[good], [good], [good.replace("goed", "geed")]]) + _rows("r", outvoted) + _rows("s", [["", None]])
    df = spark.createDataFrame(rows, FRAMES["transcriptions"])
    got = {x["page_id"]: x for x in voting.reconciled(voting.voted(df)).collect()}
    assert got["p"]["text_final"] == "15 Maart 1945.\nLieve Vader, Moeder en Han," and got["p"]["uncertain_spans"][-1]["alternatives"] == ["Hans,"]
    assert got["q"]["text_final"] == good and [tuple(s) for s in got["q"]["uncertain_spans"]] == [(1, "goed", ["geed"])]
    assert got["r"]["text_final"] == "Wim v. Alloosel" and got["r"]["uncertain_spans"][0]["alternatives"] == ["Ollosel"] and got["s"]["text_final"] == "\n"
    assert voting.voted(df.limit(0)).count() == 0
    assert {x["page_id"]: x["body"] for x in voting.doubts(voting.voted(df)).collect()}["q"] == "1: Ik hoop dat jullie het {goed|geed} maakt"


def test_order_of_readings(spark):
    df = spark.createDataFrame(_rows("p", [["a b"]], "cloud_a") + _rows("p", [["a c"]], "cloud"), FRAMES["transcriptions"])
    first = voting.ranked(df).where("place = 1").first()
    assert first["engine"] == "cloud" and voting.voted(df).first()["tokens"][1]["text"] == "c"


def test_corrected(spark):
    v = voting.voted(spark.createDataFrame([x for p in "abc" for x in _rows(p, [["een twee", "drie"], ["een tvee", "drie"]])], FRAMES["transcriptions"]))
    said = '```json\n{"lines":[{"n":1,"text":"EEN"},{"n":"x","text":"y"}],"uncertain":[{"n":2,"word":"drie"}]}\n```'
    replies = spark.createDataFrame([("a", said), ("b", "geen json"), ("d", said)], "page_id string, reply string")
    got = {r["page_id"]: r for r in voting.corrected(v, replies).collect()}
    assert got["a"]["text_final"] == "EEN\ndrie" and [tuple(s) for s in got["a"]["uncertain_spans"]] == [(2, "drie", [])]
    assert got["b"]["text_final"] == got["c"]["text_final"] == "een twee\ndrie" and len(got["b"]["uncertain_spans"]) == len(got["c"]["uncertain_spans"]) == 1


def test_cluster():
    assert fuzzy.canonicalise(["Harry Jansen", "Jansen Harry", "Harrie Jansen", "Piet"]) == {"Harrie Jansen": "Harrie Jansen", "Harry Jansen": "Harrie Jansen", "Jansen Harry": "Harrie Jansen", "Piet": "Piet"}
    assert fuzzy.indel_ratio("", "") == 100 and fuzzy.indel_ratio("abc", "abd") == pytest.approx(66.6667, abs=1e-3)


def test_leaderboard(spark):
    gold = spark.createDataFrame([("p", "# c\nLieve Vader\n\nHet is goed")], "page_id string, gold_text string")
    rows = [("p", "fake", "m", "v1", "page", 0, i + 1, t, "high", None) for i, t in enumerate(["Lieve Vader", "Het is goed"])]
    tr = spark.createDataFrame(rows + rows, FRAMES["transcriptions"])
    b = scoring.leaderboard(scoring.score(scoring.join_lines(tr), gold)).collect()
    assert len(b) == 1 and b[0]["cer"] == 0 and b[0]["wer"] == 0 and b[0]["samples"] == 1


def test_upsert(spark):
    e = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    n = spark.createDataFrame([(9, "a"), (8, None)], "v int, k string")
    got = sorted(map(tuple, store.upsert(e, n, ["k"]).collect()), key=str)
    assert got == sorted([("b", 3), (None, 2), ("a", 9), (None, 8)], key=str)
    again = store.upsert(store.upsert(e, n.where("k = 'a'"), ["k"]), n.where("k = 'a'"), ["k"])
    assert again.count() == 3


def test_replace_bags(spark):
    e = spark.createDataFrame([("a", "1"), (None, "2"), ("b", "3")], "letter_id string, x string")
    n = spark.createDataFrame([("a", "9")], "letter_id string, x string")
    assert sorted(map(tuple, store.replace_bags(e, n).collect())) == [("a", "9"), ("b", "3")]
    assert store.replace_bags(e, n.limit(0)).count() == 2


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.read("letters").count() == 0
    s.review("p1", "tekst", "ik")
    s.review("p1", "andere tekst", "ik")
    s.review("p2", "x", "ik")
    assert s.read("letters").count() == 2 and s.frame("letters", page_id="p1").first()["text_final"] == "andere tekst"
    s.set_meta("L1", date="1945-03-15", place="Solo")
    s.set_meta("L1", date="niets")
    row = s.read("letter_meta").first()
    assert row["date"] is None and row["place"] is None
    with pytest.raises(KeyError):
        s.assign("nope", None, None)
    with pytest.raises(KeyError):
        s.read("nope")
    m = s.export(str(tmp_path / "out"))
    assert m["frames"]["letters"]["rows"] == 2 and "transcriptions" not in m["frames"]
    new = spark.createDataFrame([("p1",), ("p3",)], "page_id string")
    assert [r[0] for r in store.unprotected(new, s.read("letters")).collect()] == ["p3"]
    e = spark.createDataFrame([("A", "place", "x", None, None, None), (None, "place", "y", None, None, None), ("B", "place", "z", None, None, None)], FRAMES["entities"])
    s.write("entities", e)
    s.replace("entities", e.where("letter_id = 'A'").withColumn("name", F.lit("new")))
    assert sorted((r["letter_id"], r["name"]) for r in s.read("entities").collect()) == [("A", "new"), ("B", "z")]


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(store.Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            s.review("p0", "a", "ik")
        with pytest.raises(RuntimeError):  # never an empty frame in place of what can't be read
            s.read("letters")
    for f in (tmp_path / "letters").iterdir():
        shutil.rmtree(f)
    s.review("p1", "een", "ik")
    with monkeypatch.context() as m:
        m.setattr(store.Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            s.review("p1", "twee", "ik")
    assert s.read("letters").first()["text_final"] == "een"
    reader = s.read("letters")  # its files stay while others write
    s.review("p1", "drie", "ik")
    assert reader.first()["text_final"] == "een" and s.read("letters").first()["text_final"] == "drie"
    base = s._state("letters")
    s.review("p2", "vier", "ik")
    with pytest.raises(RuntimeError):  # a writer that began before does not undo it
        s.write("letters", s.read("letters").limit(0), None, base)
    assert s.read("letters").count() == 2


def test_ingest(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "1945-03-15_p1.JPG").write_bytes(b"one")
    (d / "1945-03-15_p2.jpg").write_bytes(b"two")
    (d / "note.txt").write_text("x")
    p = files.register(files.images(spark, str(d)))
    rows = {r["filename"]: r for r in p.collect()}
    assert len(rows) == 2 and rows["1945-03-15_p2.jpg"]["page_no"] == 2 and len(rows["1945-03-15_p1.JPG"]["page_id"]) == 16
    s = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        watch(spark, str(d), s, str(tmp_path / "cp")).awaitTermination()
    assert s.read("pages").count() == 2
    (d / "copy.jpg").write_bytes(b"one")
    watch(spark, str(d), s, str(tmp_path / "cp")).awaitTermination()
    assert s.read("pages").count() == 2
    g = tmp_path / "gold"
    g.mkdir()
    (g / "1945-03-15_p2.txt").write_text("gold")
    (g / "other.txt").write_text("gold")
    assert files.gold(spark, str(g), s.read("pages")).count() == 1
    (tmp_path / "names.txt").write_text("# head\nHan \n # x\n\nFrits\n")
    assert [r[0] for r in files.names(spark, str(tmp_path / "names.txt")).collect()] == ["Han", "# x", "Frits"]
    assert files.render("a {names} {x", names="Han") == "a Han {x"
    assert files.size(sinks.png(np.zeros((3, 5), np.uint8))) == (5, 3) and files.size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 3, 5)) == (5, 3)
    assert files.size(b"") == files.size(b"\xff\xd8\xff") == files.size(b"RIFF") == (None, None)
    tiff = b"II*\x00\x08\x00\x00\x00" + struct.pack("<H", 3) + struct.pack("<HHII", 0x010F, 2, 4, int.from_bytes(b"Cam\x00", "little")) + struct.pack("<HHIHH", 256, 3, 1, 7, 0) + struct.pack("<HHII", 257, 4, 1, 9)
    assert files.exif(tiff) == (None, "Cam") and files.size(tiff) == (7, 9)
    assert files.exif(b"") == (None, None) and files.exif(b"Exif\x00\x00II") == (None, None)


def test_models(spark):
    pages = spark.createDataFrame([("p", "regel een\nregel twee")], "page_id string, message string")
    r = transcribe.generate(pages, transcribe.engine("echo"), samples=2)
    assert transcribe.to_lines(r, "e", "m", "v", "x").count() == 4
    with pytest.raises(ValueError):
        transcribe.engine("nope")
    replies = spark.createDataFrame([("L1-1945-03-15", '{"people":[{"name":"Han"}],"places":[{"name":"Solo"}],"events":[{"date":"1945-03"}],"summary_nl":"s"}', "m"), ("L2", "geen json", "m")], "letter_id string, reply string, model string")
    meta = spark.createDataFrame([], FRAMES["letter_meta"])
    out = transcribe.enrich(replies, meta)
    assert out["entities"].count() == 2 and out["summaries"].count() == 2
    said = '{"people":[{"name":"Harry Jansen","role_guess":"vriend"},{"name":"Harrie Jansen"}],"places":[{"name":"Batavia","modern_name":"Jakarta"}],"notable_quotes":["q"]}'
    got = transcribe.enrich(spark.createDataFrame([("L", said, "m")], "letter_id string, reply string, model string"), meta)
    assert {(r["name"], r["detail"], r["canonical"]) for r in got["entities"].collect()} == {("Harry Jansen", "vriend", "Harrie Jansen"), ("Harrie Jansen", None, "Harrie Jansen"), ("Batavia", "Jakarta", "Batavia")}
    assert got["summaries"].first()["notable_quotes"] == ["q"]
    ev = {r["source"]: r["date"] for r in out["events"].collect()}
    assert ev == {"extracted": dt.date(1945, 3, 1), "letter_date": dt.date(1945, 3, 15)}


def test_images(spark):
    assert images.order_quad([[10, 90], [90, 90], [90, 10], [10, 10]]).tolist() == [[10, 10], [90, 10], [90, 90], [10, 90]]
    b = images.cut_bands(np.zeros((1000, 300)), 5, 0.2)
    assert len(b) == 5 and b[0].shape[0] > 200 and sum(x.shape[0] for x in b) > 1000
    s = images.stretch(np.array([0, 76, 128, 204, 255]))
    assert s[0] == 0 and s[1] == 0 and 0 < s[2] < 255 and s[3] == 255 and s[4] == 255
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0, 76, 128, 204, 255)], "v int").select(images.stretched(F.col("v"))).collect()]
    assert got == s.tolist()
    assert images.warp(np.arange(100).reshape(10, 10), [[0, 0], [9, 0], [9, 9], [0, 9]], 10, 10).tolist() == np.arange(100).reshape(10, 10).tolist()
    assert images.resize_long_side(np.zeros((100, 50)), 200).shape == (200, 100)
    flat = np.full((40, 60), 77, np.uint8)
    assert (images.resize_long_side(flat, 30) == 77).all() and (images.resize_long_side(flat, 90) == 77).all()
    y, x = np.mgrid[0:600, 0:800]
    photo = np.where((y > 80 + (x - 150) * 0.0) & (y < 520) & (x > 150 - (y - 80) * 10 / 420) & (x < 650 - (y - 80) * 10 / 440), 230, 30).astype(np.uint8)
    photo[200:205, 200:500] = 20
    quad = images.find_page_quad(photo)
    assert np.abs(quad[0] - [150, 80]).max() <= 8 and images.warp(photo, quad).shape[0] > 380 and images.warp(photo, quad).shape[1] > 480
    assert images.find_page_quad(np.full((60, 80), 200, np.uint8)) is None
    assert images.suppress_bleed(flat, 0) is flat and (images.suppress_bleed(flat, 1.0) > 250).all()
    page, bands, _ = images.preprocess(np.stack([photo] * 3, -1), images.Config(long_side=300, bands=3, bleed_kernel=15))
    assert max(page.shape) == 300 and len(bands) == 3 and page.mean() > 150
    assert images.cut_bands(flat, 1)[0] is flat
    assert sinks.encode_image(photo, 100)[1] in ("image/png", "image/jpeg")


def test_views(spark):
    letters = spark.createDataFrame([("p1", "een\nhet Huis\ndrie\nvier", None), ("p2", None, None)], "page_id string, text_final string, x string")
    pages = spark.createDataFrame([("p1", "A-1945-01-02", 1, "f1"), ("p2", "A-1945-01-02", 2, "f2"), ("p3", None, None, "f3")], "page_id string, letter_id string, page_no int, filename string")
    h = views.search(letters, pages, "huis").collect()
    assert len(h) == 1 and h[0]["line_no"] == 2 and "«Huis»" in h[0]["snippet"]
    assert views.search(letters, pages, "h").count() == 0
    told = {r["page_id"]: r for r in views.page_context(pages, letters).collect()}
    assert told["p2"]["tail"] == "het Huis\ndrie\nvier" and told["p2"]["context"] == "Letter id: A-1945-01-02.\nThis is page 2 of the letter.\nThe previous page ended with:\nhet Huis\ndrie\nvier"
    assert told["p1"]["context"] == "Letter id: A-1945-01-02.\nThis is page 1 of the letter." and told["p3"]["context"] == ""
    meta = spark.createDataFrame([], FRAMES["letter_meta"])
    i = views.letter_index(pages, meta).collect()
    assert [r["letter"] for r in i] == ["A-1945-01-02", "(los) f3"] and i[0]["page_ids"] == ["p1", "p2"]


def test_archive(spark, tmp_path):
    photos, root = tmp_path / "in", tmp_path / "root"
    photos.mkdir()
    for k in (1, 2):
        y, x = np.mgrid[0:120, 0:160]
        (photos / f"1945-03-15_p{k}.png").write_bytes(sinks.png(np.where((y > 10) & (y < 110) & (x > 10 + k) & (x < 150), 230, 30).astype(np.uint8)))
    run = lambda *a: main.run(spark, [str(root), *a])
    assert run("ingest", str(photos)) == "2 pages registered" == run("ingest", str(photos))
    a = Archive(spark, str(root))
    ids = {r["page_no"]: r["page_id"] for r in a.pages().collect()}
    assert [r["page_no"] for r in a.pages().collect()] == [1, 2] and a.pages().first()["width"] == 160
    assert run("preprocess", "--bands", "2", "--long-side", "100") == "2 pages processed" and run("preprocess") == "0 pages processed"
    assert a.image(ids[1], "processed").endswith(f"{ids[1]}.jpg") and a.image(ids[1]).endswith("p1.png")
    with pytest.raises(KeyError):
        a.image("nope")
    (root / "gold").mkdir()
    (root / "gold" / "1945-03-15_p1.txt").write_text("# c\nLieve Vader\n\nHet is goed\n")
    assert run("gold", "--seed") == "1 checked texts put into letters\n1 checked texts match 2 pages"
    prompt = tmp_path / "p.md"
    prompt.write_text("Lees dit.")
    assert run("transcribe", "--prompt", str(prompt), "--samples", "2", "--with-bands").endswith("lines written")
    n = a.frame("transcriptions").count()
    run("transcribe", "--prompt", str(prompt), "--samples", "2", "--with-bands")
    assert a.frame("transcriptions").count() == n and {r["variant"] for r in a.frame("transcriptions").collect()} == {"page+bands"}
    assert run("reconcile") == "1 pages reconciled" and a.frame("letters", page_id=ids[1]).first()["text_source"] == "gold"
    assert a.reconcile(corrector=transcribe.replay()) == 1
    a.review(ids[2], "Met vriendelijke groet", "ik")
    assert run("gold", "--promote") == "1 reviewed pages written\n2 checked texts match 2 pages" and (root / "gold" / "1945-03-15_p2.txt").read_text() == "Met vriendelijke groet\n"
    board, detail = a.evaluate()
    models = {r["model"]: r["cer"] for r in board.where("engine = 'final'").collect()}
    assert models == {"gold": 0.0, "reviewed": 0.0} and "0.000" in run("evaluate") and detail.first()["cer"] >= detail.tail(1)[0]["cer"]
    got = a.enrich(lambda: lambda m, t: '{"people":[{"name":"Han","role_guess":"broer"}],"summary_en":"s"}')
    assert got == {"entities": 1, "events": 1, "summaries": 1} and a.frame("entities", letter_id="1945-03-15").first()["detail"] == "broer"
    out = tmp_path / "out"
    assert "pages" in run("export", str(out)) and len(list((out / "images").iterdir())) == 2
    import pyarrow as pa

    t = pa.ipc.open_file(io.BytesIO(b"".join(a.arrow("letters", page_id=ids[1])))).read_all()
    assert t.num_rows == 1 and t.column("text_final")[0].as_py() == "Lieve Vader\nHet is goed"
    assert {n: x.count() for n, x in a.load(str(out)).items()}["pages"] == 2
    assert [r[0] for r in a.pick(page=["x", "x"]).collect()] == ["x"] and a.pick(letter="1945-03-15").count() == 2 == a.pick().count()


def test_messages(spark):
    pages = spark.createDataFrame([("p", "i.jpg", ["b0.jpg"], "Letter id: L."), ("q", "j.jpg", None, "")], "page_id string, image string, bands array<string>, context string")
    shots = spark.createDataFrame([("p", "g", 1, "g.jpg")], "page_id string, shot string, n bigint, image string")
    gold = spark.createDataFrame([("g", "# c\nLieve")], "page_id string, gold_text string")
    m = transcribe.messages(pages, shots, gold).select("page_id", "messages", transcribe.user_turns(F.col("messages")).alias("k"), transcribe.flattened(F.col("messages")).alias("flat"))
    got = {r["page_id"]: r for r in m.collect()}
    assert [x["role"] for x in got["p"]["messages"]] == ["user", "assistant", "user"] and got["p"]["k"] == 2 and got["q"]["k"] == 1
    assert got["p"]["messages"][1]["parts"][0]["text"] == '{"lines":[{"n":1,"text":"Lieve","confidence":"high"}]}'
    assert [x["path"] for x in got["p"]["messages"][2]["parts"]] == ["i.jpg", "b0.jpg", None] and got["p"]["messages"][2]["parts"][-1]["text"].endswith("top to bottom.\nLetter id: L.")
    assert got["q"]["messages"][0]["parts"][-1]["text"] == "Transcribe this page." and got["q"]["flat"] == "[Task] Images: `j.jpg`.\nTranscribe this page."
    assert transcribe.engine("replay", {"a": "b"})()("a", 0.0) == "b"


RULES = [("H", dt.datetime(1940, 1, 1), 120, "zomertijd"), ("H", dt.datetime(1945, 10, 7, 1), 60, "wintertijd"), ("H", dt.datetime(1946, 4, 7, 1), 120, "zomertijd")]


def test_clock(spark):
    rules = spark.createDataFrame(RULES, "station string, from_utc timestamp_ntz, utc_offset_min int, clock_name string")
    d = dt.date(1946, 5, 6)
    cases = [
        (1, "06-05-1946 12:00", d, "H", "1946-05-06T10:00:00Z"), (2, None, d, "H", "1946-05-06"), (3, "32-5-1947", d, "H", None), (4, "7 April 1946 02:30", d, "H", None),
        (5, "7-10-1945 02:30", d, "H", None), (6, "7-10-1945 02:30 (wintertijd)", d, "H", "1945-10-07T01:30:00Z"), (7, "7-10-1945 02:30 Z.T.", d, "H", "1945-10-07T00:30:00Z"),
        (8, "1946-05-06 12:00", d, None, None), (9, "061200B MAY 46", d, None, "1946-05-06T10:00:00Z"), (10, "mei '46", d, None, "1946-05"), (11, "anno 1946", d, None, "1946"),
        (12, "6 Mei", d, None, "1946-05-06"), (13, "6 Mei", None, None, None), (14, "1946-05-06T12:00:05,7+0730", d, "H", "1946-05-06T04:30:05Z"), (15, "12:15 AM, 6-V-46", d, "H", "1946-05-05T22:15:00Z"),
        (16, "gisteren", d, "H", None), (17, "", d, "H", "1946-05-06"), (18, "31 Februari 1946", d, "H", None), (19, "6.5.1946 om 9u05", d, "H", "1946-05-06T07:05:00Z"), (20, "19460506T235959", d, "X", None),
        (21, "0630 hrs, 6/5/1946", d, "H", "1946-05-06T04:30:00Z"), (22, "May 6th 1946 11.00 p.m. (UTC+1)", d, None, "1946-05-06T22:00:00Z"), (23, None, None, "H", None), (24, "6-5-1990 10:00", d, "H", "1990-05-06T08:00:00Z"),
        (25, "x" * 20000, d, "H", None), (None, "1946", d, "H", None),
    ]
    ev = spark.createDataFrame([(c[0], c[1], c[2], c[3], "z") for c in cases] * 2, "event_id bigint, date_text string, date date, station string, k string")
    got = {r["event_id"]: r["normal_form"] for r in clock.normalise(ev, rules).collect()}
    assert got == {c[0]: c[4] for c in cases if c[4]}
    assert clock.normalise(ev.limit(0), rules).count() == 0 and clock.normalise(ev, rules.limit(0)).count() == 8

"""Sources, turns, splits, pairs and measures; the queries against their SQL."""

import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from talkspark import cli
from talkspark.functions import speech
from talkspark.operators import clients, evaluate, formats, pairs, split, stats, turns
from talkspark.plans.queries import ORACLES, QUERIES
from talkspark.sources import archives, files
from talkspark.streaming import process_new_files

DATA = "/root/testdata/sf0.001"


def test_monologues_like_a_loop(spark):
    r, rows, expected = random.Random(7), [], []
    for stem in range(150):
        held, kept = None, []
        for pos in range(r.randint(1, 14)):
            speaker, text = r.choice("ABC"), r.choice(["yeah", "ok right", "", "word word", "one two three four"])
            rows.append(("s", str(stem), pos, f"{stem}#{pos}", speaker, text))
            back = text in ("yeah", "ok right")
            if held and held[0] == speaker:
                held[1].append(text)
            elif held is None or not back:
                kept.append(held) if held else None
                held = (speaker, [text])
        kept.append(held)
        n = 0
        for speaker, texts in kept:
            joined = " ".join(" ".join(texts).split())
            if len(joined.split()) >= 2:
                n += 1
                expected.append((str(stem), f"{stem}#mono_{n:04d}", speaker, joined))
    frame = spark.createDataFrame(rows, "source string, stem string, pos int, utterance_id string, speaker string, text string")
    got = turns.build_monologues(frame, min_tokens=2).select("stem", "monologue_id", "speaker", "text").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


CHAT = "@Begin\n@Participants:\tA,\n\tB\n@Languages:\teng\n@Languages:\tfra\n*AB:\thello \x15100_200\x15\n\n   more 250_300 50_90\n???\n\tend\x15\n*C2:\tbye\n@End"


def test_chat_files(spark, tmp_path):
    (tmp_path / "x1.cha").write_text(CHAT)
    found = files.read_whole(spark, str(tmp_path))
    rows = [tuple(r) for r in files.parse_chat(found).select("stem", "pos", "utterance_id", "speaker", "text", "t_start_ms", "t_end_ms", "metadata").orderBy("pos").collect()]
    assert rows == [("x1", 1, "x1#0001", "AB", "hello more end", 50, 300, '{"line_no":6}'), ("x1", 2, "x1#0002", "C2", "bye", None, None, '{"line_no":11}')]
    headers = files.chat_headers(found).collect()[0]["headers"]
    assert headers == {"Begin": [""], "Participants": ["A, B"], "Languages": ["eng", "fra"], "End": [""]}
    assert [r[0] for r in files.stems(found, ".cha").collect()] == ["x1"]


def test_switchboard_files(spark):
    rows = [("sw1A-ms98-a-trans.text", "sw1A-0003 0.0005 1.5 hi  there\nbad line\nother 2.0 3 [noise]"), ("sw1B-ms98-a-trans.text", "sw1B-0001 0.0005 0.0015 yo\n")]
    got = files.parse_switchboard(spark.createDataFrame(rows, "file string, content string")).orderBy("pos").select("utterance_id", "speaker", "text", "t_start_ms", "t_end_ms").collect()
    assert [tuple(r) for r in got] == [("sw1#A_0003", "A", "hi  there", 0, 1500), ("sw1#B_0001", "B", "yo", 0, 2), ("sw1#A_0001", "A", "[noise]", 2000, 3000)]


def test_nxt_channel():
    ns = 'xmlns:nite="http://nite.sourceforge.net/"'
    words = f'<r {ns}><w nite:id="a">Hi</w><w nite:id="b" punc="true">,</w><gap nite:id="c"/><w nite:id="d" punc="true">.</w><w nite:id="e"> </w><vocalsound nite:id="f" type="cough"/></r>'
    seg = lambda i, h: f'<segment nite:id="{i}" transcriber_start="1.0005"><nite:child href="x#{h}"/></segment>'
    out = files.nxt_segments(words, f'<r {ns}>{seg("1", "id(a)..id(f)")}{seg("2", "id(f)..id(c)")}{seg("3", "id(a)")}{seg("4", "id(zz)")}{seg("5", "id(e)")}<segment nite:id="6"/></r>')
    assert [(s["segment_id"], s["text"]) for s in out] == [("1", "Hi, [gap] . [vocalsound:cough]"), ("2", "[gap] . [vocalsound:cough]"), ("3", "Hi")]


def test_jsonl(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"pair_id": "1", "style": "é", "more": 1}\n\n  \n{"pair_id": "2"}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "ok.jsonl"), files.PAIR_SCHEMA, ("pair_id",))
    assert rows.count() == 2 and files.write_jsonl(rows, str(tmp_path / "out")) == 2
    for bad in ("{oops", '["a"]', '[{"pair_id": "1"}]', "3"):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception):
            files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), files.PAIR_SCHEMA).collect()
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "ok.jsonl"), files.PAIR_SCHEMA, ("source",)).collect()


def _speakers(spark):
    rows = [(f"{k}#m{i}", f"sp{k}", ("x", "y")[k % 2], k * 100 + i) for k in range(20) for i in range(1 + k % 5)]
    return spark.createDataFrame(rows, "monologue_id string, speaker string, meeting_type string, pos int"), rows


def test_split(spark):
    frame, rows = _speakers(spark)
    got = split.split_by_speaker(frame).collect()
    by = {}
    for r in got:
        by.setdefault(r["split"], set()).add(r["speaker"])
    assert len(got) == len(rows) and sum(map(len, by.values())) == 20 and set(by) == set(split.SPLITS)
    assert sorted(split.split_by_speaker(frame.repartition(5)).collect()) == sorted(got)
    assert sum(r["n_speakers"] for r in split.split_manifest(split.split_by_speaker(frame)).collect()) == 20
    hashed = split.split_by_hash(frame).collect()
    assert len(hashed) == len(rows) and all(len({r["split"] for r in hashed if r["speaker"] == s}) == 1 for s in {r["speaker"] for r in hashed})
    for bad in ((0.5, 0.5, 0.1), (1.0, 0.0, 0.0)):
        with pytest.raises(ValueError):
            split.split_by_speaker(frame, bad)


def test_sample(spark):
    frame, rows = _speakers(spark)
    got = split.sample_balanced(frame, target=20).collect()
    sizes = {s: sum(r[1] == s for r in rows) for _, s, _, _ in rows}
    kinds = {k: sum(r["meeting_type"] == k for r in got) for k in "xy"}
    assert all(sum(g["speaker"] == s for g in got) == sizes[s] for s in {g["speaker"] for g in got})
    assert all(10 <= n <= 14 for n in kinds.values())
    assert split.sample_balanced(frame, target=10**6).count() == len(rows)
    assert split.sample_by_hash(frame, 20).count() >= 20
    mixed = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", None)], "speaker string, meeting_type string")
    assert sorted(map(tuple, split.majority_type(mixed).collect())) == [("s", "a"), ("t", "unknown")]


def test_pairs_and_cache(spark, tmp_path):
    rows = [("s", "m1", "A", "hi <pause:long> there .."), ("s", "m2", "A", "hi there .."), ("s", "m3", "B", "fail"), ("s", "m4", "B", "known")]
    mono = spark.createDataFrame(rows, "source string, monologue_id string, speaker string, text string")
    log = tmp_path / "calls"

    def call(system, user):
        with log.open("a") as f:
            f.write(user + "\n")
        if user == "fail":
            raise RuntimeError("no")
        return f"“{user}”"

    def store(df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/answers")
        return spark.read.parquet(f"{tmp_path}/answers")

    none = spark.createDataFrame([], pairs.CACHE_SCHEMA)
    plain = call
    call = lambda system, user: (plain(system, user), {"finish_reason": "stop", "tokens": 3})
    made, new = pairs.to_pairs(mono, none, call, model="m:free", alias="m", store=store)
    assert json.loads(made.collect()[0]["metadata"]) == {"finish_reason": "stop", "tokens": 3, "model": "m:free", "model_alias": "m", "prompt_version": "v2-zero-shot", "from_cache": False}
    got = {r["monologue_id"]: r for r in made.collect()}
    assert set(got) == {"m1", "m2", "m4"} and got["m1"]["formal_text"] == '"hi there .."'
    assert got["m1"]["spoken_text"] == "hi <pause:long> there." and got["m1"]["pair_id"] == "m1#casual#v2-zero-shot"
    assert sorted(log.read_text().split("\n")[:-1]) == ["fail", "hi there ..", "known"]  # equal texts are asked for once
    again, _ = pairs.to_pairs(mono, spark.createDataFrame(new.collect(), pairs.CACHE_SCHEMA), call, model="m:paid", alias="m", store=store)
    assert again.where("metadata like '%\"from_cache\":true%'").count() == 3


def test_patience():
    waits, answers = [], iter([pairs.RateLimited("3"), pairs.RateLimited(None), pairs.RateLimited("soon"), "done"])

    def call(system, user):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert pairs.patient(call, waits.append)("", "") == "done" and waits == [3.0, 60.0, 60.0]
    with pytest.raises(pairs.RateLimited):
        pairs.patient(lambda s, u: (_ for _ in ()).throw(pairs.RateLimited("61")), waits.append)("", "")
    waits.clear()
    with pytest.raises(pairs.RateLimited):
        pairs.patient(lambda s, u: (_ for _ in ()).throw(pairs.RateLimited("1")), waits.append)("", "")
    assert waits == [1.0] * 5


def test_repunctuation(spark):
    rows = [("<pause:long> so y- you <pause:short> <pause:long> know <pause:short>", "So, y- you know?"), ("a b", "a c"), ("<pause:long>", "x"), ("a b", None)]
    got = pairs.repunctuate(spark.createDataFrame(rows, "spoken_text string, answer string")).collect()
    assert [(r["spoken_text"], r["reason"]) for r in got] == [("<pause:long> So, y- you <pause:short> <pause:long> know? <pause:short>", "ok"), ("a b", "word_mismatch"), ("<pause:long>", "empty"), ("a b", "error")]


def test_formats(spark):
    p = spark.createDataFrame([("p", "s", "casual", "A", "so um", "So.", "m", "{}")], files.PAIR_SCHEMA)
    row = formats.format_pairs(p, "seq2seq").collect()[0]
    assert row["input"].startswith("<style:casual>\n") and row["input"].endswith("Input:\nSo.\n\nOutput:") and row["target"] == "so um"
    chat = formats.format_pairs(p, "chat").collect()[0]
    assert [m["role"] for m in chat["messages"]] == ["user", "assistant"]
    with pytest.raises(Exception):
        formats.format_pairs(p.withColumn("style", F.lit("loud")), "chat").collect()
    with pytest.raises(ValueError):
        formats.model_format("none")
    with pytest.raises(ValueError):
        formats.hub_id("qwen3-4b")
    assert formats.model_table(spark).count() == 7 and formats.style_table(spark).count() == 2


def test_separation(spark):
    texts = [("casual", t) for t in ("um well yes.", "like uh so. ok.", "um no.")] + [("semi_formal", t) for t in ("This is a long and calm sentence.", "It goes on for a while and ends.", "Another of that kind is here.")]
    got = {r["feature"]: r for r in stats.style_separation(spark.createDataFrame(texts, "style string, text string")).collect()}
    assert got["filler_rate"]["cohens_d"] < -0.8 and got["filler_rate"]["matches_expected"] and not got["filler_rate"]["collapsed"]
    same = stats.style_separation(spark.createDataFrame([(s, "a b.") for s in ("casual", "semi_formal") for _ in range(3)], "style string, text string")).collect()
    assert all(r["cohens_d"] == 0 and r["collapsed"] for r in same)
    with pytest.raises(Exception):
        stats.style_separation(spark.createDataFrame([("casual", "a")], "style string, text string")).collect()


def test_distribution_is_exact(spark):
    long = spark.createDataFrame([("k", "m", float(v)) for v in (1, 2, 3, 10, 10)], "k string, metric string, value double")
    assert list(stats.distributions(long, ["k"]).collect()[0])[2:] == [5, 1.0, 10.0, 5.2, 3.0]


def test_spokenness(spark):
    rows = [(f"p{i}", "s", "casual", "A", f"um it's like gonna go well {i}", f"It is going to proceed in an orderly manner and number {i} ends it.", "m", "{}") for i in range(60)]
    p = spark.createDataFrame(rows, files.PAIR_SCHEMA)
    model, metrics = evaluate.train_spokenness(p)
    assert metrics["holdout_auc"] > 0.95 and metrics["coefficients"]["filler_rate"] > 0
    mine = evaluate.score_spokenness(p, "spoken_text", model).agg(F.avg("p_spoken")).collect()[0][0]
    theirs = model.transform(evaluate.with_features(p, "spoken_text").select(*evaluate.FEATURES))
    assert abs(mine - sum(r["probability"][1] for r in theirs.collect()) / 60) < 1e-9
    score = lambda r, body, out: evaluate.score_spokenness(r, body, model, out)
    preds = p.select("pair_id", "style", "speaker", F.col("formal_text").alias("input"), F.lit(None).cast("string").alias("reference"), F.col("spoken_text").alias("prediction"))
    shift = {(r["style"], r["metric"]): r for r in evaluate.spoken_shift(preds, score).collect()}
    assert shift[(None, "delta")]["mean"] > 0.5 and shift[("casual", "delta")]["n"] == 60
    with pytest.raises(ValueError):
        evaluate.train_spokenness(p.limit(0))
    made = evaluate.generate(preds.drop("prediction"), lambda xs: [x + " ." for x in xs], batch=7)
    assert made.where("prediction like '% .'").count() == 0


def test_archives(tmp_path):
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name in ("corpus/words/a.A.words.xml", "corpus/segments/a.A.segments.xml", "__MACOSX/words/x.xml", "corpus/corpusResources/meetings.xml", "corpus/other/b.xml", "corpus/readme"):
            z.writestr(name, "<r/>")
    got = archives.download("ami", "u", str(tmp_path), lambda url: buf.getvalue())
    assert [os.path.relpath(p, tmp_path) for p in got] == ["corpusResources/meetings.xml", "segments/a.A.segments.xml", "words/a.A.words.xml"]
    assert archives.download("ami", "u", str(tmp_path), lambda url: 1 / 0) == got
    with pytest.raises(RuntimeError):
        archives.download("sbcsae", "u", str(tmp_path / "s"), lambda url: buf.getvalue())


def test_repunctuation_of_pairs(spark):
    """The model gets words without pauses, once each, and not at all where none are left; answers and failures are told."""
    rows = [("p1", "so <pause:short> yes ."), ("p2", "so yes ."), ("p3", "<pause:long>"), ("p4", "no good"), ("p5", "fail")]
    frame = spark.createDataFrame([(i, "s", "casual", "A", t, "F.", "m", '{"a":1}') for i, t in rows], files.PAIR_SCHEMA)

    def call(system, user):
        assert system == pairs.REPUNCT_PROMPT and "<" not in user and user
        if user == "fail":
            raise RuntimeError("no")
        return {"so yes .": "So, yes. ", "no good": "not good"}[user], {"n": 1}

    none = spark.createDataFrame([], pairs.CACHE_SCHEMA)
    made, new = pairs.repunctuate_pairs(frame, none, call, model="m")
    got = {r["pair_id"]: (r["spoken_text"], json.loads(r["metadata"])) for r in made.collect()}
    told = lambda applied, reason, cached=False: {"a": 1, "tier_b": {"applied": applied, "reason": reason, "from_cache": cached}}
    assert got == {"p1": ("So, <pause:short> yes.", told(True, "ok")), "p2": ("So, yes.", told(True, "ok")), "p3": ("<pause:long>", told(False, "empty")), "p4": ("no good", told(False, "word_mismatch")), "p5": ("fail", told(False, "error:RuntimeError"))}
    assert made.columns == frame.columns and new.count() == 2
    again, _ = pairs.repunctuate_pairs(frame.where("pair_id <> 'p5'"), new, lambda s, u: 1 / 0, model="m")
    assert again.where("metadata like '%\"from_cache\":true%'").count() == 3


def test_chat_client():
    """Against a server of our own: the request's form, metadata, refusals, answers without content."""
    import http.server
    import threading

    seen, replies = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code, headers, body = replies.pop(0)
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = clients.ChatClient("m", f"http://127.0.0.1:{server.server_port}/v1/", "k", clients.routing({"LLM_PROVIDER_SORT": "price", "LLM_PROVIDER_MAX_PROMPT": "0.5"}))
    reply = lambda content: {"model": "m-1", "choices": [{"message": {"content": content}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 4, "completion_tokens": 2, "total_tokens": 6}}
    replies += [(200, {}, reply("hi")), (429, {"Retry-After": "3"}, {}), (200, {}, reply(None))]
    assert client("sys", "usr") == ("hi", {"response_model": "m-1", "finish_reason": "stop", "prompt_tokens": 4, "completion_tokens": 2, "total_tokens": 6})
    assert seen[0] == ("/v1/chat/completions", "Bearer k", {"model": "m", "messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": "usr"}], "provider": {"sort": "price", "max_price": {"prompt": 0.5}}})
    with pytest.raises(pairs.RateLimited) as refused:
        client("sys", "usr")
    assert refused.value.wait == "3"
    with pytest.raises(ValueError):
        client("sys", "usr")
    assert clients.routing({}) == {}
    server.shutdown()


def toy_tagger():
    kinds = {"dog": "NOUN", "runs": "VERB", "off": "ADP", "she": "PRON"}
    return lambda text: [(w, kinds.get(w, "X"), "prt" if w == "off" else "", "VERB" if w == "off" else "") for w in text.split()]


def test_speech_features(spark):
    texts = [(s, t) for s, t in (("casual", "she runs off <pause:long> 1"), ("casual", "dog"), ("semi_formal", "the dog runs"), ("semi_formal", ""))]
    frame = spark.createDataFrame(texts, "style string, text string")
    more = speech.speech_features(toy_tagger)
    got = frame.select("text", *[c.alias(k) for k, c in more(F.col("text")).items()]).collect()
    assert [tuple(round(x, 4) for x in r[1:]) for r in got] == [(0.3333, 1.0, 0.3333), (1.0, 0.0, 0.0), (0.6667, 0.0, 0.0), (0.0, 0.0, 0.0)]
    rows = {r["feature"]: r for r in stats.style_separation(frame, more=more).collect()}
    assert rows["lexical_density"]["used_for_verdict"] and rows["phrasal_verb_ratio"]["casual_mean"] == 0.5


def answer(system: str, user: str) -> str:
    return user.capitalize()


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(1, 6):
        lines = "".join(f"*{'ABCDEFGHIJ'[2 * n - 1 - i % 2]}:\t{'so we <(.)> talked about this and that for a long time ' * 4}\n" for i in range(6)).replace("<(.)>", "(.)")
        (tmp_path / "in" / f"c{n}.cha").write_text("@Begin\n" + lines + "@End\n")
    args = ["sbcsae", "--data-dir", f"{tmp_path}/data", "--input", f"{tmp_path}/in", "--client", f"{__name__}:answer", "--repunct", f"{__name__}:answer", "--through", "stats"]
    assert cli.main(["run", *args], spark) == 0
    made = spark.read.parquet(f"{tmp_path}/data/pairs")
    assert made.count() == 30 and made.where("spoken_text like 'So we <pause:short> talked%'").count() == 30
    # both caches have their answers; nothing is asked for again
    assert spark.read.parquet(f"{tmp_path}/data/cache/pairs").count() == spark.read.parquet(f"{tmp_path}/data/cache/repunct").count() == 1
    assert cli.main(["pairs", *args[:-6], "--client", f"{__name__}:refuse", "--repunct", f"{__name__}:refuse"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/data/pairs").where("metadata like '%from_cache\":true%from_cache\":true%'").count() == 30
    assert cli.main(["aggregate", *args], spark) == 0
    assert cli.main(["split", *args, "--output", f"{tmp_path}/split"], spark) == 0
    manifest = {r["split"]: r for r in json.loads(spark.read.text(f"{tmp_path}/split/_MANIFEST").collect()[0][0])}
    assert {k: (r["ratio"], r["seed"]) for k, r in manifest.items()} == {"train": (0.8, 42), "validation": (0.1, 42), "test": (0.1, 42)}
    assert cli.main(["format", "--model", "t5gemma2-1b", "--input", f"{tmp_path}/split", "--output", f"{tmp_path}/rows"], spark) == 0
    # no pair changes its split
    splits = {(r["pair_id"], r["split"]) for r in spark.read.json(f"{tmp_path}/split").collect()}
    assert splits == {(r["pair_id"], r["split"]) for r in spark.read.json(f"{tmp_path}/rows").collect()} and len(splits) == 30
    told = json.loads(spark.read.text(f"{tmp_path}/rows/_MANIFEST").collect()[0][0])[0]
    assert told["counts"] == {k: r["n_rows"] for k, r in manifest.items()} and told["format"] == "seq2seq" and told["styles_present"] == ["casual"] and told["style_tokens"]["casual"] == "<style:casual>"
    assert cli.main(["train"], spark) == 2 and cli.main(["parse"], spark) == 2
    # a stem that isn't there fails by itself
    assert cli.main(["run", *args[:-2], "--stems", "c1", "nowhere"], spark) == 1
    assert spark.read.json(f"{tmp_path}/data/failed/SBCSAE").select("stem").collect()[0][0] == "nowhere"
    assert spark.read.parquet(f"{tmp_path}/data/monologues").count() > 0


def refuse(system: str, user: str) -> str:
    raise AssertionError("asked again")


def test_broken_transcripts_fail_by_themselves(spark, tmp_path):
    ns = 'xmlns:nite="http://nite.sourceforge.net/"'
    (tmp_path / "in").mkdir()
    for stem, words in (("M1", f'<r {ns}><w nite:id="a">Hi</w></r>'), ("M2", f"<r {ns}><w>")):
        (tmp_path / "in" / f"{stem}.A.words.xml").write_text(words)
        (tmp_path / "in" / f"{stem}.A.segments.xml").write_text(f'<r {ns}><segment nite:id="1" transcriber_start="1"><nite:child href="x#id(a)"/></segment></r>')
    assert cli.main(["run", "ami", "--data-dir", f"{tmp_path}/data", "--input", f"{tmp_path}/in", "--through", "clean"], spark) == 1
    assert [r["text"] for r in spark.read.parquet(f"{tmp_path}/data/cleaned").collect()] == ["Hi"]
    assert [r["stem"] for r in spark.read.json(f"{tmp_path}/data/failed/AMI").collect()] == ["M2"]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cha").write_text(CHAT)
    for _ in range(2):  # the second run finds nothing new; a batch that is tried again replaces itself
        process_new_files(spark, f"{tmp_path}/in", files.parse_chat, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine = QUERIES[name](spark, DATA)
    theirs = con.sql(f"select {', '.join(mine.columns)} from ({ORACLES[name]})").fetchall()
    key = lambda r: tuple(str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in r)
    assert sorted(map(key, mine.collect())) == sorted(map(key, theirs)) and theirs

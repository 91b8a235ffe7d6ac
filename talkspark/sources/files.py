"""Transcript files of three corpora as one utterance table.

Utterances: source, stem, pos, utterance_id, speaker, text, t_start_ms, t_end_ms, metadata
(JSON). Order is data: ``pos`` counts a stem's rows in the order of the corpus.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspark.functions.text import CLEANERS, KEEPS_EMPTIED_ROWS
from talkspark.operators.turns import BACKCHANNELS, TELEPHONE_BACKCHANNELS

NAK = "\x15"
_STAMP = rf"{NAK}?(?<![0-9])([0-9]+)_([0-9]+)(?![0-9]){NAK}?"
UTTERANCE = ["source", "stem", "pos", "utterance_id", "speaker", "text", "t_start_ms", "t_end_ms", "metadata"]


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, content); names that begin with _ or . are skipped, as everywhere in Spark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def stems(files: DataFrame, suffix: str) -> DataFrame:
    """The sorted names before ``suffix``."""
    return files.where(F.col("file").endswith(suffix)).select(F.expr(f"left(file, char_length(file) - {len(suffix)})").alias("stem")).distinct().orderBy("stem")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _chat_records(files: DataFrame) -> DataFrame:
    """(file, kind, name, line_no, body): headers and utterances with the lines that continue them."""
    lines = files.select("file", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("i", "line")).where("line <> ''")
    say, head, more = r"^\*([A-Z0-9]+):(?U:\s*)(.*)$", r"^@([\p{L}\p{N}_]+)(?::(?U:\s*)(.*))?$", r"^(?U:\s+)(.*)$"
    kind = F.when(F.col("line").rlike(say), "utterance").when(F.col("line").rlike(head), "header").when(F.col("line").rlike(more), "more")
    lines = lines.withColumn("kind", kind).where("kind is not null")
    first = lambda n: F.when(F.col("kind") == "utterance", F.regexp_extract("line", say, n)).when(F.col("kind") == "header", F.regexp_extract("line", head, n))
    lines = lines.withColumn("name", first(1)).withColumn("piece", F.when(F.col("kind") == "more", F.regexp_extract("line", more, 1)).otherwise(first(2)))
    lines = lines.withColumn("record", F.sum((F.col("kind") != "more").cast("int")).over(W.partitionBy("file").orderBy("i")))
    joined = F.array_sort(F.collect_list(F.struct("i", _stripped(F.col("piece")).alias("piece"))))
    rows = lines.where("record > 0").groupBy("file", "record").agg(F.min_by("kind", "i").alias("kind"), F.min_by("name", "i").alias("name"), (F.min("i") + 1).alias("line_no"), joined.alias("parts"))
    return rows.select("file", "kind", "name", "line_no", _stripped(F.array_join("parts.piece", " ")).alias("body"))


def chat_headers(files: DataFrame) -> DataFrame:
    """(file, headers): map of each key to its values in order."""
    rows = _chat_records(files).where("kind = 'header'")
    keys = rows.groupBy("file", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]).alias("body"))
    return keys.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "body"))).alias("headers"))


def parse_chat(files: DataFrame, source: str = "SBCSAE") -> DataFrame:
    rows = _chat_records(files).where("kind = 'utterance'").withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("file").orderBy("line_no")).cast("long"))
    times = lambda g, pick: pick(F.transform(F.regexp_extract_all("body", F.lit(_STAMP), F.lit(g)), lambda x: x.cast("long")))
    bare = F.replace(F.regexp_replace("body", _STAMP, ""), F.lit(NAK), F.lit(""))
    text = F.when(bare == F.col("body"), F.col("body")).otherwise(_stripped(F.regexp_replace(bare, r"(?U)\s+", " ")))
    return rows.select(F.lit(source).alias("source"), "stem", "pos", F.format_string("%s#%04d", "stem", "pos").alias("utterance_id"), F.col("name").alias("speaker"), text.alias("text"), times(1, F.array_min).alias("t_start_ms"), times(2, F.array_max).alias("t_end_ms"), F.to_json(F.struct("line_no")).alias("metadata"))


def _milliseconds(seconds: Column) -> Column:
    """Half to even, like the source's clock arithmetic."""
    return F.bround(seconds.cast("double") * 1000, 0).cast("long")


def parse_switchboard(files: DataFrame, source: str = "SWITCHBOARD") -> DataFrame:
    """Files <stem><A|B>-ms98-a-trans.text; both sides by start time, A first where equal."""
    name, line = r"^(.*)([AB])-ms98-a-trans\.text$", r"^(\S+)\s+([0-9.]+)\s+([0-9.]+)\s+(.*)$"
    rows = files.where(F.col("file").rlike(name)).select(F.regexp_extract("file", name, 1).alias("stem"), F.regexp_extract("file", name, 2).alias("side"), F.posexplode(F.split("content", "\r\n|\n|\r")).alias("i", "raw"))
    rows = rows.withColumn("line", _stripped(F.col("raw"))).where(F.col("line").rlike(line))
    part = lambda g: F.regexp_extract("line", line, g)
    rows = rows.withColumn("t_start_ms", _milliseconds(part(2))).withColumn("t_end_ms", _milliseconds(part(3)))
    index = F.row_number().over(W.partitionBy("stem", "side").orderBy("i")) - 1
    own = F.regexp_extract(part(1), r"-([0-9]+)$", 1)
    rows = rows.withColumn("seq", F.when(own != "", own).otherwise(F.format_string("%04d", index)))
    pos = F.row_number().over(W.partitionBy("stem").orderBy(F.coalesce("t_start_ms", F.lit(0)), "side", "i")).cast("long")
    return rows.select(F.lit(source).alias("source"), "stem", pos.alias("pos"), F.concat("stem", F.lit("#"), "side", F.lit("_"), "seq").alias("utterance_id"), F.col("side").alias("speaker"), _stripped(part(4)).alias("text"), "t_start_ms", "t_end_ms", F.to_json(F.struct(part(1).alias("orig_id"), "side")).alias("metadata"))


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _nite(e: ET.Element) -> str:
    return e.attrib.get("{http://nite.sourceforge.net/}id", "")


def nxt_segments(words_xml: str, segments_xml: str) -> list[dict]:
    """Segments of one channel with the text of the words that they span."""
    shown: list[tuple[str, str, bool] | None] = []
    place: dict[str, int] = {}
    for e in ET.fromstring(words_xml):
        if not (wid := _nite(e)):
            continue
        kind, token = _tag(e), None
        if kind == "w":
            token = (e.text or "").strip() or None
        elif kind == "vocalsound":
            token = f"[vocalsound:{e.attrib.get('type', '')}]"
        elif kind in ("disfmarker", "gap", "transformerror"):
            token = f"[{kind}]"
        place.setdefault(wid, len(shown))
        shown.append(token and (token, kind, e.attrib.get("punc") == "true"))
    out = []
    for e in ET.fromstring(segments_xml):
        child = next((c for c in e if _tag(c) == "child"), None) if _tag(e) == "segment" else None
        if child is None:
            continue
        ids = [x.rpartition(")")[0].partition("(")[2] for x in child.attrib.get("href", "").partition("#")[2].split("..", 1)]
        ends = sorted(place.get(i, -1) for i in (ids[0], ids[-1]))
        text: list[str] = []
        for item in shown[ends[0] : ends[1] + 1] if ends[0] >= 0 else ():
            if item is None:
                continue
            token, kind, punctuation = item
            if kind == "w" and punctuation and text and not text[-1].startswith("["):
                text[-1] += token
            else:
                text.append(token)
        if text:
            out.append({"segment_id": _nite(e), "text": " ".join(text), "start": e.attrib.get("transcriber_start") or None, "end": e.attrib.get("transcriber_end") or None})
    return out


def _segments(words: str, segments: str) -> Column:
    """struct<segments, error>: XML that isn't well formed is told, not raised."""

    def tried(w: str, s: str) -> dict:
        try:
            return {"segments": nxt_segments(w, s), "error": None}
        except ET.ParseError as e:
            return {"segments": [], "error": str(e)}

    @F.pandas_udf("struct<segments:array<struct<segment_id:string,text:string,start:string,end:string>>,error:string>")
    def parse(w: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tried(a, b) for a, b in zip(w, s, strict=True)], columns=["segments", "error"])

    return parse(words, segments)


def nxt_speakers(meetings: DataFrame) -> DataFrame:
    """meetings: (content) of meetings.xml files. (stem, agent, global_name, role, meeting_type), a dimension."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(m.attrib.get("observation", ""), s.attrib.get("nxt_agent", ""), s.attrib.get("global_name", ""), s.attrib.get("role", ""), m.attrib.get("type", "")) for x in frame["content"] for m in ET.fromstring(x) if _tag(m) == "meeting" for s in m if _tag(s) == "speaker"]
            yield pd.DataFrame(rows, columns=["stem", "agent", "global_name", "role", "meeting_type"])

    return meetings.select("content").mapInPandas(work, "stem string, agent string, global_name string, role string, meeting_type string")


def _nxt_channels(files: DataFrame) -> DataFrame:
    """(stem, agent, found): the parsed channels of files <stem>.<agent>.words.xml and .segments.xml."""
    name = r"^([^.]*)\.([A-D])\.(words|segments)\.xml$"
    part = lambda g: F.regexp_extract("file", name, g)
    rows = files.where(F.col("file").rlike(name)).groupBy(part(1).alias("stem"), part(2).alias("agent"))
    rows = rows.agg(F.max(F.when(part(3) == "words", F.col("content"))).alias("words"), F.max(F.when(part(3) == "segments", F.col("content"))).alias("segments")).where("words is not null and segments is not null")
    return rows.select("stem", "agent", _segments("words", "segments").alias("found"))


def nxt_failures(files: DataFrame) -> DataFrame:
    """(stem, agent, error) of the channels that can't be parsed; their stems have no utterances."""
    return _nxt_channels(files).select("stem", "agent", "found.error").where("error is not null")


def parse_nxt(files: DataFrame, speakers: DataFrame, source: str = "AMI") -> DataFrame:
    """Files <stem>.<agent>.words.xml and .segments.xml; the channels by start time, then agent. A stem with a broken file is left out whole."""
    rows = _nxt_channels(files).withColumn("failed", F.count("found.error").over(W.partitionBy("stem"))).where("failed = 0")
    rows = rows.select("stem", "agent", F.posexplode("found.segments").alias("i", "s")).select("stem", "agent", "i", "s.*")
    rows = rows.join(speakers.dropDuplicates(["stem", "agent"]), ["stem", "agent"], "left")
    rows = rows.withColumn("t_start_ms", _milliseconds(F.col("start"))).withColumn("t_end_ms", _milliseconds(F.col("end")))
    pos = F.row_number().over(W.partitionBy("stem").orderBy(F.coalesce("t_start_ms", F.lit(0)), "agent", "i")).cast("long")
    known = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(F.lit(source).alias("source"), "stem", pos.alias("pos"), F.concat_ws("#", "stem", "segment_id").alias("utterance_id"), F.coalesce(F.nullif("global_name", F.lit("")), F.concat_ws(".", "stem", "agent")).alias("speaker"), "text", "t_start_ms", "t_end_ms", F.to_json(F.struct("agent", known("role"), known("meeting_type"), "segment_id")).alias("metadata"))


def clean(utterances: DataFrame, corpus: str) -> DataFrame:
    """``text`` normalised; chat keeps rows that become empty, the others drop them."""
    out = utterances.withColumn("text", CLEANERS[corpus](F.col("text")))
    return out if corpus in KEEPS_EMPTIED_ROWS else out.where("text <> ''")


@dataclass(frozen=True)
class Corpus:
    source: str
    cleaner: str
    parse: Callable[..., DataFrame]
    suffix: str
    backchannels: tuple[str, ...] = BACKCHANNELS


CORPORA = {
    "ami": Corpus("AMI", "nxt", parse_nxt, ".A.words.xml"),
    "sbcsae": Corpus("SBCSAE", "chat", parse_chat, ".cha"),
    "switchboard": Corpus("SWITCHBOARD", "switchboard", parse_switchboard, "A-ms98-a-trans.text", TELEPHONE_BACKCHANNELS),
}

PAIR_SCHEMA = "pair_id string, source string, style string, speaker string, spoken_text string, formal_text string, monologue_id string, metadata string"
UTTERANCE_SCHEMA = "source string, utterance_id string, speaker string, text string, t_start_ms long, t_end_ms long, metadata string"
MONOLOGUE_SCHEMA = "source string, monologue_id string, speaker string, text string, utterance_ids array<string>, n_tokens int, metadata string"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    return parse_jsonl(spark.read.text(path), schema, required)


def parse_jsonl(lines: DataFrame, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """lines: value. Blank lines are skipped and other keys ignored; lines that aren't objects, and rows without a required key, are errors."""
    lines = lines.where(r"value rlike '\\S'")
    lines = lines.withColumn("value", F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("value", F.lit(80))))))
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    for c in required:
        rows = rows.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"{c} is missing"))))
    return rows


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Overwrites; returns the number of rows, counted in what was written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.text(path).count()


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary (rows of distributions or counts) as one JSON document; summaries are small by construction."""
    rows = [json.loads(r[0]) for r in summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    summary.sparkSession.createDataFrame([(json.dumps(rows, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)

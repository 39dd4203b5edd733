"""Scans of song files, pages, timed lyrics, media and status documents; bad input is data, not a failure."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

SECTION = "struct<label:string,content:string>"
SONG = f"title string, artist string, url string, language string, raw_lyrics string, clean_lyrics string, sections array<{SECTION}>, primary_artist string, featured_artists array<string>, genius_song_id long, _corrupt_record string"
INDEX = "genius_song_id long, title string, primary_artist string, featured_artists array<string>, category string, url string, status string, json_path string"


def songs(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<category>/*.json``, one song a file: the song, its path, category and ``is_bad``.

    Files whose name begins with _ are left out; unreadable ones are rows with ``is_bad``.
    """
    df = spark.read.schema(SONG).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/*.json")
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("category"), F.col("_corrupt_record").isNotNull().alias("is_bad")).drop("_corrupt_record")


def with_index(songs_df: DataFrame, index: DataFrame) -> DataFrame:
    """Songs with what an index says of the same relative path; its artist counts before the file's."""
    key = F.concat_ws("/", "category", F.element_at(F.split("path", "/"), -1))
    side = index.select(F.col("json_path").alias("_key"), F.col("primary_artist").alias("_artist"), "status")
    return songs_df.withColumn("_key", key).join(side, "_key", "left").withColumn("primary_artist", F.coalesce(F.nullif("_artist", F.lit("")), "primary_artist", "artist")).drop("_key", "_artist")


def unified_index(songs_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, log): the first file of each title and artist in path order; the others with ``duplicate_of``."""
    w = Window.partitionBy(T.key_part(F.col("title")), T.key_part(F.coalesce("primary_artist", "artist"))).orderBy("path")
    ranked = songs_df.where(~F.col("is_bad")).withColumn("_n", F.row_number().over(w)).withColumn("duplicate_of", F.first("path").over(w))
    return ranked.where("_n = 1").drop("_n", "duplicate_of"), ranked.where("_n > 1").select("title", "primary_artist", F.col("path").alias("source_path"), "duplicate_of")


def library(spark: SparkSession, root: str) -> DataFrame:
    """clip_id, date_folder, title of every ``*_metadata.json`` below a folder; unreadable files are left out."""
    fields = "id string, clip_id string, title string, _corrupt_record string"
    df = spark.read.schema(fields).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_metadata.json").json(root).select("*", F.col("_metadata.file_path").alias("_path"))
    named = lambda c: F.nullif(c, F.lit(""))
    inside = F.element_at(F.split("_path", F.lit(r"\Q" + root.rstrip("/") + r"\E/")), -1)
    folder, stem = F.regexp_replace(inside, "/?[^/]*$", ""), F.regexp_replace(inside, r"^.*/|\.json$", "")
    return df.where("_corrupt_record is null").select(F.coalesce(named("id"), named("clip_id"), stem).alias("clip_id"), folder.alias("date_folder"), F.coalesce(named("title"), F.lit("Untitled")).alias("title"))


def dataset(df: DataFrame) -> DataFrame:
    """A dataset document's songs, one a row, with ``lyrics_latin``."""
    return df.select(F.explode("songs").alias("s")).select("s.*").withColumn("lyrics_latin", T.clean_lyrics(F.col("lyrics")))


def last_extract(df: DataFrame, url: str, file: str) -> DataFrame:
    """Of several extracts, each URL's row from the last file, with its clip id and lyrics from the first label on."""
    w = Window.partitionBy(url).orderBy(F.desc(file))
    out = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out.withColumn("clip_id", T.clip_id(F.col(url)))


def candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header whose ragged rows are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def timed_lyrics(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """``[mm:ss.xx] text`` lines as seconds and text; the fraction is a decimal fraction; other lines go."""
    at = r"^\[(\d+):(\d{1,2})(?:[.:](\d{1,3}))?\]\s*(.*)$"
    part = lambda k: F.regexp_extract(text_col, at, k)
    second = part(1).cast("double") * 60 + part(2).cast("double") + F.coalesce(F.concat(F.lit("0."), F.nullif(part(3), F.lit(""))).cast("double"), F.lit(0.0))
    return lines.where(F.col(text_col).rlike(at)).select("*", second.alias("second"), part(4).alias("line")).drop(text_col)


def media_inventory(spark: SparkSession, root: str, extensions: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """path, length, modificationTime of media files below a folder in the order of their lower-case names."""
    name = F.element_at(F.split("path", "/"), -1)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    df = df.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(extensions)).orderBy(F.lower(name), "path").offset(offset)
    return df if limit is None else df.limit(limit)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, length and SHA-256 of every file below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"), "modificationTime")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and verdict (ok, missing, added, changed) of two manifests."""
    a, b = old.select("path", F.col("sha256").alias("_a")), new.select("path", F.col("sha256").alias("_b"))
    verdict = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed").otherwise("ok")
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict"))


def boundaries(df: DataFrame) -> DataFrame:
    """Section boundaries from ``sections`` or ``structure.sections``: numbers only, end after start, by start."""
    rows = df.select("track_id", F.explode(F.coalesce("sections", "structure.sections")).alias("s"))
    out = rows.select("track_id", "s.label", F.col("s.start").try_cast("double").alias("start"), F.col("s.end").try_cast("double").alias("end"))
    return out.where("end > start").orderBy("track_id", "start")


# Void elements, and elements whose text is not shown.
_VOID, _HIDDEN = {"br", "hr", "img", "input", "link", "meta"}, {"script", "style", "head", "nav"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.stack, self.in_title = "", [], [], False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "meta" and named.get("property") == "og:title":
            self.title = named.get("content") or ""
        if tag == "title":
            self.in_title = True
        if tag in ("br", "p", "div", "li", "h1", "h2", "h3"):
            self.parts.append("\n")
        if tag in _HIDDEN:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.stack:
            self.stack.pop()

    def handle_data(self, data):
        if self.in_title and not self.title:
            self.title = data.strip()
        elif not self.stack and not self.in_title:
            self.parts.append(data)


def pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Title and shown text of HTML pages; tags are parsed in Arrow batches, lines are cleaned by Spark."""

    @F.pandas_udf("title string, body string")
    def parsed(html: pd.Series) -> pd.DataFrame:
        out = []
        for x in html.fillna(""):
            p = _Page()
            p.feed(x)
            p.close()
            out.append((p.title, "".join(p.parts)))
        return pd.DataFrame(out, columns=["title", "body"])

    return T.small_batches(df).select(id_col, parsed(html_col).alias("p")).select(id_col, "p.title", T.blank_lines_cleaned(F.col("p.body")).alias("text"))


class _SongPage(HTMLParser):
    """The texts of a song page: first heading, shared title, first artist link, and its lyrics boxes, text by text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.heading, self.shared, self.artist, self.new, self.old = None, None, None, None, None
        self.open = []  # (tag, what it gathers) of the elements that are not closed

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "meta" and named.get("property") == "og:title" and self.shared is None:
            self.shared = named.get("content") or ""
        if tag in _VOID:
            return
        what = None
        if tag == "h1" and self.heading is None:
            self.heading, what = [], "heading"
        elif tag == "a" and "data-artist_id" in named and self.artist is None:
            self.artist, what = [], "artist"
        elif tag == "div" and named.get("data-lyrics-container") == "true":
            self.new, what = (self.new or []), "new"
        elif tag == "div" and "lyrics" in (named.get("class") or "").split():
            self.old, what = (self.old or []), "old"
        self.open.append((tag, what))

    def handle_endtag(self, tag):
        at = next((k for k in reversed(range(len(self.open))) if self.open[k][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        for what in {w for _, w in self.open if w}:
            getattr(self, what).append(data)


# The title of pages without one; what stands above the lyrics, besides blank lines.
_UNKNOWN = "Unknown"
_ABOVE = r"(?i)^(\d+\s+Contributors?|\d+\s+Embed|[^\[].* Lyrics)$"


def song_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", labels: bool = True) -> DataFrame:
    """id, title, artist, found, raw_lyrics, clean_lyrics of song pages; tags are parsed in Arrow batches, the rest is by Spark.

    title: the first heading without a final ``Lyrics``, else what follows the last dash of the shared title, or all of
    it; artist: the link of an artist, else what is before that dash, without what is featured; ``Unknown`` without.
    Lyrics are the boxes of the present layout, else of the older one, less the lines above them (contributors, an echo
    of the title); of a page without boxes ``found`` is false and both are null.  Clean lyrics have no blank lines and
    single blanks, and no ``[label]`` lines unless ``labels``.  A null page has no boxes.
    """

    @F.pandas_udf("heading string, shared string, artist string, raw string")
    def parsed(html: pd.Series) -> pd.DataFrame:
        out = []
        for x in html.fillna(""):
            p = _SongPage()
            p.feed(x)
            p.close()
            joined = lambda parts: None if parts is None else "".join(t.strip() for t in parts)
            lyrics = p.old if p.new is None else p.new
            out.append((joined(p.heading), p.shared, joined(p.artist), None if lyrics is None else "\n".join(lyrics)))
        return pd.DataFrame(out, columns=["heading", "shared", "artist", "raw"])

    raw = T.small_batches(df).select(F.col(id_col), parsed(html_col).alias("p")).select(id_col, "p.*")
    dash = F.when(F.contains("shared", F.lit("\u2013")), "\u2013").when(F.contains("shared", F.lit(" - ")), " - ")
    shared = F.nullif("shared", F.lit(""))
    after, before = F.substring_index("shared", "\u2013", -1), F.col("shared")
    at = F.when(dash == " - ", F.length("shared") - F.length(F.substring_index("shared", " - ", -1)) - 3).otherwise(F.length("shared") - F.length(after) - 1)
    last = F.when(dash == " - ", F.substring_index("shared", " - ", -1)).otherwise(after)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    heading = F.when(F.lower("heading").endswith(" lyrics"), trim(F.substring("heading", F.lit(1), F.length("heading") - 7))).otherwise(F.col("heading"))
    title = F.coalesce(heading, F.when(dash.isNotNull(), trim(last)).otherwise(shared), F.lit(_UNKNOWN))
    credited = F.when(dash.isNotNull(), trim(F.regexp_extract(trim(F.substring(before, F.lit(1), at)), r"(?s)^(.*?)(?: \([Ff]t\..*)?$", 1)))
    lines = F.transform(F.split(trim(F.col("raw")), "\n"), lambda x: F.struct(x.alias("x"), trim(x).alias("t")))
    rows = raw.withColumn("_ls", lines).withColumn("_skip", F.filter(F.transform("_ls", lambda s, k: F.when((s["t"] != "") & ~s["t"].rlike(_ABOVE), k)), lambda k: k.isNotNull()))
    kept = F.when(F.size("_skip") > 0, F.slice("_ls", F.get("_skip", F.lit(0)) + 1, F.size("_ls"))).otherwise(F.slice("_ls", 1, 0))
    rows = rows.withColumn("_ls", F.when(F.col("raw").isNotNull(), kept))
    shown = F.filter("_ls", lambda s: (s["t"] != "") & (F.lit(labels) | ~s["t"].rlike(_LABEL)))
    clean = F.array_join(F.transform(shown, lambda s: F.regexp_replace(s["t"], r"[ \t]+", " ")), "\n")
    return rows.select(id_col, title.alias("title"), F.coalesce("artist", credited, F.lit(_UNKNOWN)).alias("artist"), F.col("raw").isNotNull().alias("found"), F.array_join(F.transform("_ls", lambda s: s["x"]), "\n").alias("raw_lyrics"), clean.alias("clean_lyrics"))


#: A line that is a section's label.
_LABEL = r"^\[(.+?)\]$"


def page_sections(songs: DataFrame, id_col: str = "page_id", lyrics: str = "raw_lyrics") -> DataFrame:
    """id, place (from 1), label, content of the sections of song pages: what follows a label, and what is above the first
    (label null).  A label directly before another one, or at the end, has no section.
    """
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    each = songs.where(F.length(lyrics) > 0).select(id_col, F.posexplode(F.split(lyrics, "\n")).alias("_at", "_x")).withColumn("_l", F.regexp_extract(trim(F.col("_x")), _LABEL, 1))
    is_label = F.col("_l") != ""
    w = Window.partitionBy(id_col).orderBy("_at")
    each = each.withColumn("_n", F.sum(is_label.cast("int")).over(w))
    label = F.max(F.when(is_label, trim(F.col("_l"))))
    inside = F.transform(F.sort_array(F.collect_list(F.when(~is_label, F.struct("_at", "_x")))), lambda s: s["_x"])
    cut = each.groupBy(id_col, "_n").agg(label.alias("label"), inside.alias("_xs")).where(F.size("_xs") > 0)
    return cut.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("_n")).alias("place"), "label", trim(F.array_join("_xs", "\n")).alias("content"))


def each_file(df: DataFrame, process: Callable[[str, bytes], dict], result: str) -> DataFrame:
    """A user's function over (path, content): path, result struct, error.  A failure is a row, not a failed job."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, process(path, content), None))
                except Exception as e:  # the user's function may raise anything
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "result", "error"])

    return df.select("path", "content").mapInPandas(run, f"path string, result struct<{result}>, error string")


def wav_frames(df: DataFrame, hop: int = 512) -> DataFrame:
    """WAV files as frames: path, frame, t, rms, zcr, peak, chroma (12 bins).  Unreadable files give no frames."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
                        raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: np.int16, 4: np.int32}[width])
                except (wave.Error, EOFError, KeyError):
                    continue
                x = (raw.astype(np.float64) - (128 if width == 1 else 0)).reshape(-1, channels).mean(axis=1) / float(1 << (8 * width - 1))
                n = len(x) // hop
                if not n:
                    continue
                frames = x[: n * hop].reshape(n, hop)
                power = np.abs(np.fft.rfft(frames * np.hanning(hop), axis=1)) ** 2
                freq = np.fft.rfftfreq(hop, 1 / rate)
                heard = freq > 27.5
                bins = np.mod(np.round(12 * np.log2(freq[heard] / 261.625565)), 12).astype(int)
                chroma = np.stack([np.bincount(bins, p[heard], 12) for p in power])
                chroma = chroma / np.maximum(chroma.max(axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"path": path, "frame": np.arange(n), "t": np.arange(n) * hop / rate, "rms": np.sqrt((frames**2).mean(axis=1)), "zcr": (np.diff(np.signbit(frames), axis=1) != 0).mean(axis=1), "peak": np.abs(frames).max(axis=1), "chroma": chroma.tolist()})

    return df.select("path", "content").mapInPandas(run, "path string, frame long, t double, rms double, zcr double, peak double, chroma array<double>")


def key_of(frames: DataFrame, by: list[str]) -> DataFrame:
    """Pitch class and mode of each track from its mean chroma: minor if the minor third is stronger than the major."""
    mean = frames.select(*by, F.posexplode("chroma").alias("pitch", "x")).groupBy(*by, "pitch").agg(F.avg("x").alias("x"))
    g = mean.groupBy(*by).agg(F.max_by("pitch", F.struct("x", -F.col("pitch"))).alias("pitch"), F.map_from_entries(F.collect_list(F.struct("pitch", "x"))).alias("m"))
    third = lambda k: F.element_at("m", F.pmod(F.col("pitch") + k, F.lit(12)).cast("int"))
    return g.select(*by, "pitch", F.when(third(3) > third(4), "minor").otherwise("major").alias("mode"))

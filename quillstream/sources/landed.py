"""Folders of landed files as a Spark data source, in batch and as a stream that restarts without reading a file again.

`spark.dataSource.register(Landed)`, then `spark.read.format("landed")` or `spark.readStream.format("landed")` give a row per
file: path (below the folder), modified, change (new, changed or removed) and content (null if removed). What the rows hold is
taken out with `sections` and `letters`, which work on both; `refreshed` brings a stored table up to date.

Options: path; endings (comma-separated, with their points); manifests, a folder that all executors see and that one query owns
(a stream needs it; a batch with it gives what changed since its last manifest); files, the most files of one batch of a
stream; bytes, about what one partition reads.

A manifest lists the files that were there, with times and sizes, as Parquet under the number of a version. An offset is such a
number, so it stays small whatever the folder holds, and what lies between two offsets is the difference of two manifests: a
batch that is repeated finds the same files. Manifests that Spark is done with are deleted. As with Spark's own file stream the driver holds
the listing, never the contents.

Defined cases: a missing folder is an empty one; files whose names begin with a point are not seen; an empty file has a row
with empty content; a file that goes between listing and reading gives no row, its removal is the next version's; one that
changes meanwhile is read as it is and reported again. If the manifest of a stream's offset is gone the stream stops.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import html.parser
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quillstream.functions import text as t

SCHEMA = "path string, modified timestamp, change string, content binary"
_ARROW = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("change", pa.string()), ("content", pa.binary())])
_LISTED = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("size", pa.int64())])
#: Bytes of content in one Arrow batch; a larger file is a batch of its own.
_AT_ONCE = 8 << 20

Listing = dict[str, tuple[int, int]]


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path, modified in microseconds, change)."""

    files: list[tuple[str, int, str]]


class _Folder:
    """The folder, its manifests, and what differs between two listings."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = dict(options)
        self.endings = tuple(x.strip().lower() for x in self.options.get("endings", "").split(",") if x.strip())
        self.bytes = int(self.options.get("bytes", 32 << 20))

    def at(self, option: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.options[option])

    def listing(self) -> Listing:
        system, root = self.at("path")
        infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = ((i.path[len(root.rstrip("/")) + 1 :], i) for i in infos if i.type == fs.FileType.File)
        seen = ((p, i) for p, i in names if not i.base_name.startswith(".") and (not self.endings or p.lower().endswith(self.endings)))
        return {p: (i.mtime_ns // 1000, i.size) for p, i in seen}

    def versions(self) -> list[int]:
        system, root = self.at("manifests")
        names = (i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)))
        return sorted(int(n[: -len(".parquet")]) for n in names if re.fullmatch(r"[0-9]+\.parquet", n))

    def manifest(self, version: int) -> Listing:
        """The listing of a version; version 0 is an empty folder."""
        if not version:
            return {}
        system, root = self.at("manifests")
        rows = pq.read_table(f"{root}/{version:012d}.parquet", filesystem=system)
        return {p: (m, s) for p, m, s in zip(*(rows.column(c).to_pylist() for c in _LISTED.names), strict=True)}

    def keep(self, version: int, files: Listing) -> None:
        """Writes a manifest under another name and moves it, so that none is ever seen half written."""
        system, root = self.at("manifests")
        system.create_dir(root, recursive=True)
        rows = [(p, *f) for p, f in sorted(files.items())]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        pq.write_table(pa.table([pa.array(c, k) for c, k in zip(columns, _LISTED.types, strict=True)], schema=_LISTED), f"{root}/.{version:012d}", filesystem=system)
        system.move(f"{root}/.{version:012d}", f"{root}/{version:012d}.parquet")

    def forget(self, before: int) -> None:
        system, root = self.at("manifests")
        for v in self.versions():
            if v < before:
                system.delete_file(f"{root}/{v:012d}.parquet")

    def dealt(self, old: Listing, new: Listing) -> list[Files]:
        """The differences in partitions of about so many bytes each; a removed file takes none."""
        out, held = [Files([])], 0
        for path, modified, change in differences(old, new):
            size = new[path][1] if path in new else 0
            if out[-1].files and held + size > self.bytes:
                out.append(Files([]))
                held = 0
            out[-1].files.append((path, modified, change))
            held += size
        return [p for p in out if p.files]

    def read(self, files: Iterable[tuple[str, int, str]]) -> Iterator[pa.RecordBatch]:
        system, root = self.at("path")
        rows: list[tuple[str, int, str, bytes | None]] = []
        held = 0
        for path, modified, change in files:
            content = None
            if change != "removed":
                try:
                    with system.open_input_stream(f"{root}/{path}") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
            if rows and held + len(content or b"") > _AT_ONCE:
                yield _batch(rows)
                rows, held = [], 0
            rows.append((path, modified, change, content))
            held += len(content or b"")
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str, bytes | None]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def differences(old: Listing, new: Listing) -> list[tuple[str, int, str]]:
    """(path, modified, change) of what is new, changed in time or size, or removed: the oldest first, then by path."""
    there = [(p, f[0], "changed" if p in old else "new") for p, f in new.items() if old.get(p) != f]
    gone = [(p, f[0], "removed") for p, f in old.items() if p not in new]
    return sorted(there + gone, key=lambda x: (x[1], x[0]))


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder) -> None:
        self.folder = folder

    def partitions(self) -> list[Files]:
        known = self.folder.versions()[-1:] if "manifests" in self.folder.options else []
        return self.folder.dealt(self.folder.manifest(known[0] if known else 0), self.folder.listing()) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition.files)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder) -> None:
        if "manifests" not in folder.options:
            raise ValueError("a stream of landed files needs the option manifests")
        self.folder, self.most = folder, int(folder.options.get("files", 0))

    def initialOffset(self) -> dict[str, int]:
        return {"version": 0}

    def latestOffset(self) -> dict[str, int]:
        last = (self.folder.versions() or [0])[-1]
        known, present = self.folder.manifest(last), self.folder.listing()
        found = differences(known, present)
        if not found:
            return {"version": last}
        for path, _, _ in found[: self.most or None]:
            if path in present:
                known[path] = present[path]
            else:
                del known[path]
        self.folder.keep(last + 1, known)
        return {"version": last + 1}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Files]:
        if start == end:
            return []
        return self.folder.dealt(self.folder.manifest(start["version"]), self.folder.manifest(end["version"]))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition.files)

    def commit(self, end: dict[str, int]) -> None:
        self.folder.forget(end["version"])


class Landed(DataSource):
    """Files of a folder, one row each."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Folder(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Folder(self.options))


#: The least characters of a section, what a heading-like line has, names of months.
LEAST = 80
LINE_WORDS, LINE_CHARS, LINE_LOOKED_AT = (3, 16), (12, 140), 25
MONTHS = "january february march april may june july august september october november december".split()
#: Elements without text of their own, elements that hold sections' text, and the others that end one of these.
ASIDE = ("script", "style", "nav", "footer")
HOLD, END = ("p", "li", "td"), ("ul", "ol", "tr", "table", "div", "section", "article", "aside", "main")
_DROPPED = "(?is)" + "|".join(rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in ASIDE) + "|<!--.*?-->"
_BLOCK = rf"(?i)<(/?)({'|'.join(HOLD + END)})([\s>])"


def html_sections(markup: Column) -> Column:
    """Sections (n, heading, body) of markup under h1 to h3, numbered with those too short to be kept; without any heading the whole text."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(markup, F.lit("")), _DROPPED, " "), r"(?i)<(h[1-3])([\s>])", "\u0001<$1$2")
    parts = F.split(marked, "\u0001")

    def section(part: Column, i: Column) -> Column:
        blocks = F.filter(F.split(F.regexp_replace(part, _BLOCK, "\u0002<$1$2$3"), "\u0002"), lambda b: b.rlike(rf"(?i)^<({'|'.join(HOLD)})[\s>]"))
        body = F.array_join(F.filter(F.transform(blocks, t.strip_tags), lambda b: b != ""), "\n")
        return F.struct(i.alias("n"), t.strip_tags(F.regexp_extract(part, r"(?is)^<h[1-3][^>]*>(.*?)</h[1-3]", 1)).alias("heading"), body.alias("body"))

    headed = F.filter(F.transform(parts, section), lambda s: (s["n"] > 0) & (F.length(s["body"]) > LEAST))
    whole = F.array(F.struct(F.lit(1).alias("n"), F.lit(None).cast("string").alias("heading"), t.strip_tags(marked).alias("body")))
    return F.when(F.size(parts) > 1, headed).otherwise(whole)


def heading_line(block: Column) -> Column:
    """The first of a block's lines that looks like a heading: few words, most of them with capitals, mostly letters, no full stop."""
    lines = F.transform(F.slice(F.split(block, r"\r\n|\r|\n"), 1, LINE_LOOKED_AT), t.collapse)

    def fits(x: Column) -> Column:
        words = F.split(x, " ")
        n, dense = F.size(words), F.regexp_replace(x, r"\s", "")
        letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
        capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        cased = (F.upper(x) == x) & (F.lower(x) != x) | (capitals >= 0.6 * n)
        return n.between(*LINE_WORDS) & F.length(x).between(*LINE_CHARS) & ~x.rlike("[.,;]$") & (letters >= 0.7 * F.length(dense)) & cased

    line = F.get(F.filter(lines, fits), F.lit(0))
    return F.when(F.upper(line) == line, F.initcap(line)).otherwise(line)


def text_sections(text: Column) -> Column:
    """Sections (n, heading, body) of Markdown under up to three signs, or, if there are none, blocks between empty lines."""
    body = F.coalesce(text, F.lit(""))
    parts = F.split(F.regexp_replace(body, r"(?m)^(#{1,3}[ \t]+\S)", "\u0001$1"), "\u0001")
    headed = F.transform(parts, lambda p, i: F.struct(i.alias("n"), t.collapse(F.regexp_extract(p, r"^#{1,3}[ \t]+([^\n]*)", 1)).alias("heading"), F.regexp_replace(p, r"^#{1,3}[^\n]*\n?", "").alias("body")))
    blocks = F.filter(F.split(body, r"\n\s*\n"), lambda b: F.length(F.btrim(b, F.lit(" \t\r\n"))) > LEAST)
    headed = F.filter(headed, lambda s: (s["n"] > 0) & (F.length(F.btrim(s["body"], F.lit(" \t\r\n"))) > LEAST))
    return F.when(F.size(parts) > 1, headed).otherwise(F.transform(blocks, lambda b, i: F.struct((i + 1).alias("n"), heading_line(b).alias("heading"), b.alias("body"))))


def file_title(path: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    title = t.collapse(F.regexp_replace(stem, "[_-]+", " "))
    return F.when(title == "", F.substring_index(path, "/", -1)).otherwise(title)


def file_date(path: Column, modified: Column) -> Column:
    """Noon (India) of the date in a file's name, of the first day of a month named with a year, or when the file was changed."""
    name = F.lower(file_title(path))
    digits = r"(20[0-9]{2})[ .]?(0[1-9]|1[0-2])(?:[ .]?(0[1-9]|[12][0-9]|3[01]))?"
    day = F.when(F.regexp_extract(name, digits, 3) == "", "01").otherwise(F.regexp_extract(name, digits, 3))
    by_digits = F.concat_ws("-", F.regexp_extract(name, digits, 1), F.regexp_extract(name, digits, 2), day)
    word = F.left(F.regexp_extract(name, rf"(?<![a-z])({'|'.join(m for long in MONTHS for m in (long, long[:3]))})(?![a-z])", 1), F.lit(3))
    month = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), word)
    year = F.regexp_extract(name, "20[0-9]{2}", 0)
    by_word = F.when((month > 0) & (year != ""), F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lit("01")))
    noon = F.try_to_timestamp(F.concat(F.when(F.regexp_extract(name, digits, 1) != "", by_digits).otherwise(by_word), F.lit(" 12:00:00+05:30")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return F.coalesce(noon, modified)


def sections(files: DataFrame) -> DataFrame:
    """Sections of new and changed files: path, modified, published, document, n, title, summary, body. Texts are whole; a summary has 600 characters."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    found = F.when(F.lower("path").rlike(r"\.html?$"), html_sections(text)).otherwise(text_sections(text))
    s = files.where("change <> 'removed'").select("path", "modified", file_title(F.col("path")).alias("document"), F.explode(found).alias("s"))
    label = F.when(F.coalesce(F.col("s.heading"), F.lit("")) != "", F.col("s.heading")).otherwise(F.concat("document", F.lit(": section "), F.col("s.n").cast("string")))
    body = t.collapse(F.col("s.body"))
    return s.select("path", "modified", file_date(F.col("path"), F.col("modified")).alias("published"), "document", F.col("s.n").alias("n"), F.left(label, F.lit(200)).alias("title"), F.left(body, F.lit(600)).alias("summary"), body.alias("body"))


def refreshed(stored: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """`stored` rows of files that stayed as they were, with the `fresh` rows of those that are new or changed. Applying it twice changes nothing more."""
    return stored.join(files.select("path").distinct(), "path", "left_anti").unionByName(fresh)


#: Links of a letter that lead to no article, and those to the day's paper.
LINK_JUNK = re.compile(
    r"(unsubscribe|privacy|terms|preferences|manage (your )?subscription|view (it )?in (your )?browser|"
    r"download (the|our) app|app store|google play|facebook|twitter|instagram|linkedin|youtube|whatsapp|"
    r"telegram|contact us|help ?cent(er|re)|advertise|forward to a friend|sign ?in|log ?in|update profile|"
    r"refer a friend|gift)",
    re.I,
)
EPAPER = re.compile(r"(e-?paper|today'?s paper|download (the )?(pdf|paper)|digital edition|replica)", re.I)
LABEL_CHARS, LABEL_WORDS, TITLE_CHARS, LINKS = 30, 5, 220, 40
LETTER = "path string, key string, kind string, place int, title string, url string, sender string, address string, published timestamp, text string"


class _Anchors(html.parser.HTMLParser):
    """(href, label) of a letter's links in order, and its text."""

    def __init__(self, markup: str) -> None:
        super().__init__()
        self.links: list[tuple[str, str]] = []
        self.words: list[str] = []
        self.href: str | None = None
        self.label: list[str] = []
        self.silent = 0
        self.feed(markup)
        self.close()
        self.ended()

    def ended(self) -> None:
        if self.href is not None:
            self.links.append((self.href.strip(), " ".join(" ".join(self.label).split())))
        self.href, self.label = None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.silent += tag in ("script", "style")
        if tag == "a":
            self.ended()
            self.href = dict(attrs).get("href")

    def handle_endtag(self, tag: str) -> None:
        self.silent -= tag in ("script", "style") and self.silent > 0
        if tag == "a":
            self.ended()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data)
            self.label.append(data)


def letter(path: str, modified: datetime, content: bytes) -> list[tuple[Any, ...]]:
    """A newsletter as a row, and a row for each of its headline-like links and for the day's paper."""
    m = email.message_from_bytes(content, policy=email.policy.default)
    name, address = email.utils.parseaddr(str(m.get("From") or ""))
    subject = " ".join(str(m.get("Subject") or "(no subject)").split())
    try:
        sent = email.utils.parsedate_to_datetime(str(m.get("Date")))
        published = sent.replace(tzinfo=sent.tzinfo or UTC).astimezone(UTC)
    except (TypeError, ValueError):
        published = modified
    key = (m.get("Message-ID") or "").strip().strip("<>") or f"{address}:{subject}:{published.isoformat()}"
    sender = " ".join(name.split()) or address or "Newsletter"
    bodies = {kind: m.get_body((kind,)) for kind in ("html", "plain")}
    bodies = {kind: part.get_content() for kind, part in bodies.items() if part is not None}
    seen_in = _Anchors(bodies.get("html", ""))
    text = " ".join(bodies["plain"].split()) if "plain" in bodies else " ".join(" ".join(seen_in.words).split())
    base = (sender, address, published)
    out: list[tuple[Any, ...]] = [(path, key, "letter", 0, subject, None, *base, text)]
    taken: set[str] = set()
    for href, label in seen_in.links:
        if len(taken) == LINKS:
            break
        if not href.startswith("http") or href in taken:
            continue
        if EPAPER.search(label) or EPAPER.search(href):
            kind, title = "paper", f"Today's e-paper: {sender}"
        elif len(label) >= LABEL_CHARS and len(label.split()) >= LABEL_WORDS and not LINK_JUNK.search(label) and not LINK_JUNK.search(href):
            kind, title = "link", label[:TITLE_CHARS]
        else:
            continue
        taken.add(href)
        out.append((path, key, kind, len(taken), title, href, *base, None))
    return out


def letters(files: DataFrame) -> DataFrame:
    """Newsletters and their links out of new and changed files of mail. A letter's key is its message id; one that comes again under another path has the same."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LETTER.split(", ")]
        for pdf in batches:
            rows = [r for p, m, c in zip(pdf["path"], pdf["modified"], pdf["content"], strict=True) for r in letter(p, m.tz_localize("UTC").to_pydatetime(), bytes(c))]
            out = pd.DataFrame(rows, columns=names)
            out["published"] = pd.to_datetime(out["published"], utc=True).dt.tz_localize(None)
            yield out

    return files.where("change <> 'removed'").select("path", F.to_utc_timestamp("modified", F.current_timezone()).cast("timestamp_ntz").alias("modified"), "content").mapInPandas(
        parsed, LETTER.replace("published timestamp", "published timestamp_ntz")
    ).withColumn("published", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "published").cast("timestamp"))


def unseen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of letters whose key is not `known`; of letters with one key, those of the first path."""
    first = rows.groupBy("key").agg(F.min("path").alias("path"))
    return rows.join(first, ["key", "path"], "left_semi").join(known.select("key").distinct(), "key", "left_anti")

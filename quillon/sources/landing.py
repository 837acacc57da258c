"""Data sources for landed API pages, and one-file CSV.

``quillon_pages`` lands pages: rows (account, page, body) become one file each,
``<path>/<account>/<page>.json``, put in place when all tasks are done; with the option
``together`` a task's pages become one file of lines (account, page, body) in ``<path>/_together``,
for landings of very many accounts, of which each is one task's.
``quillon_follows`` reads follow lists, a task for some accounts, following cursors;
the option ``only`` keeps other accounts' files closed.  (It isn't a pushed filter:
Spark 4.1 keeps what a Python source was asked first for all frames of a load, so an
unfiltered frame would lose rows after a filtered one.)  As a stream its offset is
the next page of every account, so a query goes on at its cursors.
``quillon_people`` reads a profile with its feed and pinned post in one go; a person
that can't be read is a row with an error and stops nothing.
``quillon_csv`` writes one file: tasks write parts, the commit joins them in order.

Files are opened through pyarrow's file systems, by path or URI.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .feeds import FEED_LIMIT, PAGE_LIMIT, PAGE_ROWS, latest_unpinned, post_url, promoted

#: Accounts that one task reads, at least, and such tasks, at most.
ACCOUNTS, TASKS = 16, 4096
#: Pages that land in one file together, about.
PAGES_TOGETHER = 20_000
FOLLOWS = "account string, page int, pos int, did string, handle string"
POST = "struct<uri:string,cid:string,text:string,created_at:string,did:string,handle:string,display_name:string,reply_count:bigint,repost_count:bigint,like_count:bigint>"
PEOPLE = f"account string, error string, did string, handle string, display_name string, description string, avatar string, followers bigint, follows bigint, posts bigint, pinned {POST}, feed array<{POST}>"


class Folder:
    """A folder by path or URI."""

    def __init__(self, path: str) -> None:
        import pyarrow.fs as fs

        # Spark writes local URIs with one slash
        path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file:///") else path
        self.system, self.path = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        self.path = self.path.rstrip("/")

    def names(self, below: str = "") -> list[str]:
        import pyarrow.fs as fs

        found = self.system.get_file_info(fs.FileSelector(f"{self.path}/{below}", allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith(("_", ".")))

    def read(self, name: str) -> dict | None:
        """A JSON page; None if it isn't there."""
        try:
            with self.system.open_input_stream(f"{self.path}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def lines(self, name: str) -> Iterator[list]:
        with self.system.open_input_stream(f"{self.path}/{name}") as f:
            yield from map(json.loads, io.BufferedReader(f))

    def write(self, name: str, body: bytes) -> None:
        self.system.create_dir(f"{self.path}/{name}".rsplit("/", 1)[0], recursive=True)
        with self.system.open_output_stream(f"{self.path}/{name}") as f:
            f.write(body)

    def files(self, below: str) -> list[str]:
        import pyarrow.fs as fs

        found = self.system.get_file_info(fs.FileSelector(f"{self.path}/{below}", recursive=True, allow_not_found=True))
        return [f.path[len(self.path) + 1 :] for f in found if f.type == fs.FileType.File]

    def move(self, old: str, new: str) -> None:
        self.system.create_dir(f"{self.path}/{new}".rsplit("/", 1)[0], recursive=True)
        self.system.move(f"{self.path}/{old}", f"{self.path}/{new}")

    def remove(self, below: str) -> None:
        self.system.delete_dir_contents(f"{self.path}/{below}", missing_dir_ok=True)
        if below in (n.base_name for n in self._all()):
            self.system.delete_dir(f"{self.path}/{below}")

    def _all(self) -> list:
        import pyarrow.fs as fs

        return self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True))


# -------------------------------------------------------------------- landing


@dataclass
class Landed(WriterCommitMessage):
    folder: str


class PageWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.drafts = path, f"_drafts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Landed:
        folder, mine = Folder(self.path), f"{self.drafts}/{uuid.uuid4().hex}"
        for row in iterator:
            folder.write(f"{mine}/{quote(row['account'], safe='')}/{row['page']}.json", row["body"].encode())
        return Landed(mine)

    def commit(self, messages: list[Landed | None]) -> None:
        """Names of a task that didn't end well are in no message, so its files stay drafts."""
        folder = Folder(self.path)
        for m in messages:
            for f in folder.files(m.folder) if m else []:
                folder.move(f, f[len(m.folder) + 1 :])
        folder.remove(self.drafts)

    def abort(self, messages: list[Landed | None]) -> None:
        Folder(self.path).remove(self.drafts)


class TogetherWriter(PageWriter):
    def write(self, iterator: Iterator) -> Landed:
        folder, mine = Folder(self.path), f"{self.drafts}/{uuid.uuid4().hex}"
        name = f"{folder.path}/{mine}/_together/{uuid.uuid4().hex}.jsonl"
        folder.system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with folder.system.open_output_stream(name) as f:
            for row in iterator:
                f.write(json.dumps([row["account"], row["page"], row["body"]]).encode() + b"\n")
        return Landed(mine)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_pages"

    def schema(self) -> str:
        return "account string, page string, body string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return (TogetherWriter if self.options.get("together") == "true" else PageWriter)(self.options["path"])


# -------------------------------------------------------------------- follows


@dataclass
class Part(InputPartition):
    """Accounts with their first page and the page behind their last one."""

    accounts: list[tuple[str, int, int]]


def _follows(path: str, part: Part) -> Iterator[tuple]:
    """Rows of pages; a list ends behind the first page without a cursor, or before the first that is missing."""
    folder = Folder(path)
    for account, start, end in part.accounts:
        before = folder.read(f"{quote(account, safe='')}/{start - 1}.json") if start else {"cursor": "first"}
        for page in range(start, end):
            if not (before or {}).get("cursor"):
                break
            before = folder.read(f"{quote(account, safe='')}/{page}.json")
            for pos, row in enumerate((before or {}).get("follows", [])[:PAGE_ROWS]):
                yield account, page, pos, row.get("did"), row.get("handle")


def _grouped(accounts: list[tuple[str, int, int]], size: int) -> list[Part]:
    return [Part(accounts[at : at + size]) for at in range(0, len(accounts), size)]


class ByAccount(DataSourceReader):
    """Partitions of accounts, those that the option ``only`` (a JSON list) leaves."""

    def __init__(self, options: dict) -> None:
        self.path, self.size, self.only = options["path"], int(options.get("accounts", ACCOUNTS)), json.loads(options.get("only") or "null")

    def partitions(self) -> list[Part]:
        known = [unquote(n) for n in Folder(self.path).names()]
        wanted = known if self.only is None else sorted(set(known) & set(self.only))
        return _grouped([(a, 0, PAGE_LIMIT) for a in wanted], max(self.size, -(-len(wanted) // TASKS))) or [Part([])]


class FollowReader(ByAccount):
    def read(self, partition: Part) -> Iterator[tuple]:
        return _follows(self.path, partition)


class FollowStream(DataSourceStreamReader):
    """Offsets: the next page of every account that has landed pages."""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("accounts", ACCOUNTS))

    def initialOffset(self) -> dict:
        return {"next": {}}

    def latestOffset(self) -> dict:
        folder, ends = Folder(self.path), {}
        for name in folder.names():
            there = {n for n in folder.names(name)}
            ends[unquote(name)] = next(k for k in range(PAGE_LIMIT + 1) if k == PAGE_LIMIT or f"{k}.json" not in there)
        return {"next": {a: n for a, n in sorted(ends.items()) if n}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        new = [(a, start["next"].get(a, 0), n) for a, n in end["next"].items() if n > start["next"].get(a, 0)]
        return _grouped(new, self.size) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _follows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class Follows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_follows"

    def schema(self) -> str:
        return FOLLOWS

    def reader(self, schema) -> FollowReader:
        return FollowReader(dict(self.options))

    def streamReader(self, schema) -> FollowStream:
        return FollowStream(dict(self.options))


# --------------------------------------------------------------------- people


def _post(post: dict | None) -> tuple | None:
    if not post:
        return None
    author, record = post.get("author") or {}, post.get("record") or {}
    return (post.get("uri"), post.get("cid"), record.get("text") or "", record.get("createdAt"), author.get("did"), author.get("handle"), author.get("displayName"), post.get("replyCount") or 0, post.get("repostCount") or 0, post.get("likeCount") or 0)


def _person(account: str, read: Callable[[str], dict | None]) -> tuple:
    """The row of an account whose pages are got by name."""
    try:
        profile, feed, pinned = (read(page) for page in ("profile", "feed", "pinned"))
        if profile is None or feed is None:
            raise ValueError("no profile" if profile is None else "no feed")
        posts = [_post(item.get("post")) for item in (feed.get("feed") or [])[:FEED_LIMIT]]
        # the pinned post's own page counts only if the profile names one
        own = _post(((pinned or {}).get("thread") or {}).get("post")) if profile.get("pinnedPost") else None
        return (account, None, profile.get("did"), profile.get("handle") or account, profile.get("displayName"), profile.get("description"), profile.get("avatar"), profile.get("followersCount"), profile.get("followsCount"), profile.get("postsCount"), own, posts)
    except (ValueError, AttributeError, TypeError) as e:  # a page that is no JSON, or of another shape
        return (account, str(e)[:200], *[None] * 10)


@dataclass
class Together(InputPartition):
    """A file of pages that landed together, those of an account behind each other."""

    name: str


class PeopleReader(ByAccount):
    def partitions(self) -> list[InputPartition]:
        return [Together(n) for n in Folder(self.path).names("_together")] or super().partitions()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder = Folder(self.path)
        if isinstance(partition, Together):
            only = None if self.only is None else set(self.only)
            for account, rows in groupby(folder.lines(f"_together/{partition.name}"), key=lambda r: r[0]):
                if only is None or account in only:
                    bodies = {page: body for _, page, body in rows}
                    yield _person(account, lambda page, bodies=bodies: json.loads(bodies[page]) if page in bodies else None)
            return
        for account, _, _ in partition.accounts:
            at = quote(account, safe="")
            yield _person(account, lambda page, at=at: folder.read(f"{at}/{page}.json"))


class People(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_people"

    def schema(self) -> str:
        return PEOPLE

    def reader(self, schema) -> PeopleReader:
        return PeopleReader(dict(self.options))


# ------------------------------------------------------------------------ CSV


@dataclass
class Lines(WriterCommitMessage):
    part: int
    name: str
    rows: int


class CsvWriter(DataSourceWriter):
    """Every value quoted, quotes doubled, null as an empty value, no line break at the end; no rows is an error."""

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, _, self.file = path.rpartition("/")
        self.columns, self.drafts = columns, f"_{self.file}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Lines:
        from pyspark import TaskContext

        folder, name, n = Folder(self.path), f"{self.drafts}/{uuid.uuid4().hex}", 0
        folder.system.create_dir(f"{folder.path}/{self.drafts}", recursive=True)
        with folder.system.open_output_stream(f"{folder.path}/{name}") as f:
            for row in iterator:
                f.write(("\n" + ",".join('"' + str("" if row[c] is None else row[c]).replace('"', '""') + '"' for c in self.columns)).encode())
                n += 1
        return Lines(TaskContext.get().partitionId(), name, n)

    def commit(self, messages: list[Lines | None]) -> None:
        folder = Folder(self.path)
        try:
            parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.part)
            if not parts:
                raise ValueError("nothing to export")
            with folder.system.open_output_stream(f"{folder.path}/{self.drafts}/whole") as out:
                out.write(",".join(self.columns).encode())
                for m in parts:
                    with folder.system.open_input_stream(f"{folder.path}/{m.name}") as f:
                        while block := f.read(1 << 20):
                            out.write(block)
            folder.move(f"{self.drafts}/whole", self.file)
        finally:
            folder.remove(self.drafts)

    def abort(self, messages: list[Lines | None]) -> None:
        Folder(self.path).remove(self.drafts)


class Csv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_csv"

    def writer(self, schema, overwrite: bool) -> CsvWriter:
        return CsvWriter(self.options["path"], schema.names)


# ------------------------------------------------------------------ as frames


def register(spark: SparkSession) -> None:
    for source in (Pages, Follows, People, Csv):
        spark.dataSource.register(source)


def land(pages: DataFrame, path: str, together: bool = False) -> None:
    """Land pages (account, page, body).

    One file a page means one move a page when the landing ends; ``together`` an account's pages are
    dealt to one task and a task's pages are one file.  Such a landing is whole: it takes a folder
    without pages, and no other landing follows there.
    """
    register(pages.sparkSession)
    rows, folder = pages.select("account", F.col("page").cast("string").alias("page"), "body"), Folder(path)
    if folder.names("_together") or (together and folder.names()):
        raise ValueError(f"{path} has pages; those that land together are alone in their folder")
    if together:
        rows = rows.repartition(max(1, -(-rows.count() // PAGES_TOGETHER)), "account").sortWithinPartitions("account", "page")
    rows.write.format("quillon_pages").option("together", str(together).lower()).mode("append").save(path)


def _load(spark: SparkSession, source: str, path: str, accounts: list[str] | None) -> DataFrame:
    register(spark)
    reader = spark.read.format(source)
    return (reader if accounts is None else reader.option("only", json.dumps(accounts))).load(path)


def follows(spark: SparkSession, path: str, accounts: list[str] | None = None) -> DataFrame:
    """(account, page, pos, did, handle) of all follow lists, or of some accounts'."""
    return _load(spark, "quillon_follows", path, accounts)


def follow_stream(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("quillon_follows").load(path)


def people(spark: SparkSession, path: str, accounts: list[str] | None = None) -> DataFrame:
    """Profiles with their posts, the pinned one first, the latest other one, and the error of those that can't be read."""
    raw = _load(spark, "quillon_people", path, accounts)
    shaped = lambda p, pinned: F.struct(p["uri"].alias("uri"), p["text"].alias("text"), F.to_timestamp(p["created_at"]).alias("created_at"), post_url(p["handle"], p["uri"]).alias("url"), F.lit(pinned).alias("is_pinned"), p["reply_count"].alias("reply_count"), p["repost_count"].alias("repost_count"), p["like_count"].alias("like_count"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = raw.withColumns({"pinned": F.when(F.col("pinned").isNotNull(), shaped(F.col("pinned"), True)), "feed": F.transform("feed", lambda p: shaped(p, False))})
    rows = rows.withColumn("all_posts", promoted(F.col("pinned"), F.col("feed")))
    first = F.get("all_posts", F.lit(0))
    return rows.select(
        "account", "error", F.col("handle").alias("username"), F.coalesce(F.nullif("display_name", F.lit("")), "handle").alias("display_name"), F.coalesce("description", F.lit("")).alias("bio"), F.col("avatar").alias("avatar_url"),
        zero("followers").alias("follower_count"), zero("follows").alias("following_count"), zero("posts").alias("posts_count"),
        F.when(first["is_pinned"], first).alias("pinned_post"), latest_unpinned(F.col("all_posts")).alias("recent_post"), F.col("all_posts").alias("posts"),
    )


def write_csv_file(rows: DataFrame, path: str) -> None:
    """One CSV file in the order of the rows."""
    register(rows.sparkSession)
    rows.write.format("quillon_csv").mode("append").save(path)

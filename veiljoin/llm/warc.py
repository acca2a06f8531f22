"""WARC archives: written by Spark's text writer, read back in parallel with boundary-chain verification.

The files of an archive are records one after the other. Tasks that read parts of a file split
it at every magic, also at those inside payloads; each such candidate claims where its record
ends. Only candidates on the chain of claims from the start of the file are records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, save, shared_dir, small

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 5 hex digits are 4 base32 digits."""
    digest = F.sha1(data)
    digits = []
    for i in range(8):
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substr(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of each row.

    Equal payloads are those of one SHA-1, MD5 and length. The smallest id of them is the response.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("bigint"),
            "payload_digest": sha1_base32(F.col("payload").cast("binary")),
            "same": F.unhex(F.md5(F.col("payload").cast("binary"))),
        }
    )
    key = ["payload_digest", "same", "payload_bytes"]
    shared = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy(*key)
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return rows.join(small(save(shared, "warc-shared")), key, "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def record_text() -> Column:
    """One record without its closing CRLF CRLF, which the writer adds. A revisit has no payload."""
    response = F.col("record_type") == "response"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    safe = lambda c: F.regexp_replace(c, r"[\r\n]+", "%0A")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit("2020-01-01T00:00:00Z")),
        line("WARC-Target-URI", safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.when(response, F.lit("")).otherwise(
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
            )
        ),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("payload_bytes")).otherwise(F.lit(0))),
        F.lit("\r\n"),
        F.when(response, F.col("payload")).otherwise(F.lit("")),
    )


def write_warc(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", min_bytes: int = 0,
) -> str:
    """Write one record per row to a folder of archives and return the folder.

    Null payloads and URLs count as empty. Of rows with equal payloads of at least ``min_bytes``
    bytes the smallest id is a response, the others revisit it; rows that repeat that id are
    responses too. A null id is written as empty. An empty table gives a folder without records.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    records = plan_records(pages, id_col, url_col, payload_col, min_bytes)
    records.select(record_text().alias("value")).write.option("lineSep", END).text(path)
    return path


def header(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n"))
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


CANDIDATE = (
    "file string, block bigint, at bigint, size bigint, length bigint, id string, type string, uri string, "
    "refers string, digest string, payload_length bigint, body bigint, found string"
)


def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece between magics: where it lies in its part of the file, and the record it claims to start.

    ``length`` is the claimed length from the magic to the end of CRLF CRLF, null for a piece that
    has no readable header. ``found`` is the digest of the body if the piece holds all of it.
    """
    offsets: dict[tuple[str, int], int] = {}
    for batch in batches:
        out = []
        for file, block, start, data in zip(batch["file"], batch["block"], batch["block"], batch["data"]):
            data = bytes(data)
            first = start == 0 and (file, block) not in offsets
            at = offsets.get((file, block), 0)
            size = len(data) + (0 if first else len(MAGIC))
            offsets[file, block] = at + size
            if not size:  # nothing stands before the first magic
                continue
            head, gap, rest = data.partition(b"\r\n\r\n")
            fields = {} if first or not gap else header(head)
            n = fields.get("content-length", "")
            if not n.isdigit():
                out.append((file, block, at, size, None, None, None, None, None, None, None, None, None))
                continue
            n = int(n)
            length = len(MAGIC) + len(head) + 4 + n + 4
            whole = rest[n:] == b"\r\n\r\n"
            claimed = fields.get("x-payload-length", "")
            out.append((
                file, block, at, size, length, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"),
                fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                int(claimed) if claimed.isdigit() else None, n, base32(rest[:n]) if whole else None,
            ))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CANDIDATE.split(", ")]).astype(object)


def exits(nodes: pd.DataFrame) -> pd.DataFrame:
    """Of each candidate in one part of a file, where its chain of claims leaves the part; null if it ends at no candidate."""
    nodes = nodes.sort_values("at")
    out: dict[int, int | None] = {}
    last = int(nodes["at"].iloc[-1])
    for at, then in zip(nodes["at"].to_numpy()[::-1].tolist(), nodes["next"].tolist()[::-1]):
        past = None if pd.isna(then) else int(then)
        out[at] = past if past is None or past > last else out.get(past)
    file, part = nodes["file"].iloc[0], nodes["block"].iloc[0]
    return pd.DataFrame({"file": file, "block": part, "at": list(out), "exit": pd.array(list(out.values()), dtype="Int64")})


def walk(nodes: pd.DataFrame) -> pd.DataFrame:
    """The candidates on the chain that starts at those which are reached from other parts of the file."""
    after = {at: None if pd.isna(then) else int(then) for at, then in zip(nodes["at"].tolist(), nodes["next"].tolist())}
    on: set[int] = set()
    for at in nodes["at"][nodes["entry"]].tolist():
        while at in after and at not in on:
            on.add(at)
            at = after[at]
    return pd.DataFrame({"file": nodes["file"].iloc[0], "at": sorted(on)})


def reachable(nodes: DataFrame) -> DataFrame:
    """Of nodes (file, block, at, next) those on the chain that starts at 0, by pointer jumping.

    A part of a file, which is as large as Spark reads at once, is one group: there each pointer becomes the one that
    leaves the part. Only nodes that such pointers meet can be entries to a part, a few a part; over these each round
    doubles the reach: what a reached entry points to is reached, then each pointer becomes the pointer of
    what it points to. It stops when a round reaches nothing new; then each part is walked from its entry.
    """
    nodes = save(nodes, "warc-nodes")
    left = save(nodes.groupBy("file", "block").applyInPandas(exits, "file string, block bigint, at bigint, exit bigint"), "warc-exits")
    met = left.filter("exit is not null").select("file", F.col("exit").alias("at")).distinct().hint("merge")
    entries = left.filter("at = 0").unionByName(left.filter("at > 0").join(met, ["file", "at"], "left_semi"))
    state = save(entries.select("file", "at", F.col("exit").alias("next"), (F.col("at") == 0).alias("on")), "warc-chain")
    count = -1
    while (now := state.filter("on").count()) != count:
        count = now
        hit = state.filter("on and next is not null").select("file", F.col("next").alias("at"), F.lit(True).alias("hit"))
        jump = state.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        state = save(
            state.join(hit.distinct().hint("merge"), ["file", "at"], "left")
            .join(jump.hint("merge"), ["file", "next"], "left")
            .select("file", "at", F.col("then").alias("next"), (F.col("on") | F.col("hit").isNotNull()).alias("on")),
            "warc-chain",
        )
    reached = state.filter("on").select("file", "at", F.lit(True).alias("entry")).hint("merge")
    marked = nodes.join(reached, ["file", "at"], "left").select("file", "block", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "block").applyInPandas(walk, "file string, at bigint")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of archives: page_id, uri, record_type, refers_to, digest, payload_length, body, found, intact.

    ``digest`` and ``payload_length`` are the header's, ``body`` is the record's own length and
    ``found`` the digest of its body, computed here; ``intact`` says that they agree.
    """
    bound_batches(spark)
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("data"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    pieces = save(lines.mapInPandas(candidates, CANDIDATE), "warc-pieces")
    parts = pieces.groupBy("file", "block").agg(F.sum("size").alias("part"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("file", "block", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("base"))
    placed = save(
        pieces.join(starts.hint("merge"), ["file", "block"]).withColumn("at", F.col("base") + F.col("at")).drop("base"), "warc-placed"
    )
    chain = reachable(placed.select("file", "block", "at", (F.col("at") + F.col("length")).alias("next")))
    records = placed.join(chain.hint("merge"), ["file", "at"], "left_semi").filter("length is not null").drop("block")
    split = records.filter("found is null")
    if not split.isEmpty():
        records = records.filter("found is not null").unionByName(joined_records(lines, starts, records, split))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    revisit = F.col("type") == "revisit"
    return records.select(
        page(F.col("id")).alias("page_id"), "uri", F.col("type").alias("record_type"),
        F.when(revisit, page(F.col("refers"))).alias("refers_to"), "digest", "payload_length", "body", "found",
        (revisit | ((F.col("digest") == F.col("found")) & (F.col("body") == F.col("payload_length")))).alias("intact"),
    )


def joined_records(lines: DataFrame, starts: DataFrame, records: DataFrame, split: DataFrame) -> DataFrame:
    """Records whose payload holds magics: their pieces, put together again, one record a group."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets: dict[tuple[str, int], int] = {}
        for batch in batches:
            at = []
            for file, block, data in zip(batch["file"], batch["block"], batch["data"]):
                here = offsets.get((file, block))
                at.append(here or 0)
                offsets[file, block] = (here or 0) + len(data) + (0 if here is None and block == 0 else len(MAGIC))
            yield batch.assign(at=at)

    pieces = lines.mapInPandas(place, "data binary, file string, block bigint, at bigint").join(starts.hint("merge"), ["file", "block"])
    ends = split.select("file", F.col("at").alias("first"), (F.col("at") + F.col("length")).alias("past"), "body")
    spread = ends.withColumn("slot", F.explode(F.sequence(F.shiftright("first", 20), F.shiftright(F.col("past") - 1, 20))))
    mine = (
        pieces.select("file", (F.col("at") + F.col("base")).alias("at"), "data")
        .withColumn("slot", F.shiftright("at", 20))
        .join(spread.hint("merge"), ["file", "slot"])
        .filter("at >= first and at < past")
    )

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        data = MAGIC.encode().join(bytes(x) for x in group["data"])
        body = data.partition(b"\r\n\r\n")[2][: int(group["body"].iloc[0])]
        return pd.DataFrame({"file": [group["file"].iloc[0]], "at": [group["first"].iloc[0]], "again": [base32(body)]})

    found = mine.groupBy("file", "first").applyInPandas(whole, "file string, at bigint, again string")
    return split.join(found.hint("merge"), ["file", "at"]).withColumn("found", F.col("again")).drop("again").select(*records.columns)

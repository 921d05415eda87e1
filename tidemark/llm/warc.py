"""A content-addressed WARC archive.

Payload bytes are stored once, under a digest that is verified on reading; every record keeps its
own exact header text in another table; joining the two gives back the original records. Digests
narrow all that is shuffled: payload bytes move only when records are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, store, written
from .lines import probable

# Fixed value: RFC 4648's base 32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# Fixed value: the end of a WARC line.
CRLF = "\r\n"


def base32(hexadecimal: Column) -> Column:
    """Base 32 of 40 hex digits (SHA-1): 5 hex digits are 4 letters."""
    parts = []
    for i in range(8):
        n = F.conv(F.substring(hexadecimal, 1 + 5 * i, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def payload(html: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


#: The date of records whose pages carry none (the tables have no time of capture).
NO_DATE = "1970-01-01T00:00:00Z"


def record_uri(page_id: Column, url: Column, sha256: Column, copy: Column) -> Column:
    """A record's own id: the page's number and a hash of what else tells records apart."""
    parts = [F.coalesce(page_id.cast("string"), F.lit("null")), F.when(url.isNull(), "n").otherwise("u"), F.coalesce(url, F.lit("")), sha256, copy.cast("string")]
    return F.concat(F.lit("<urn:page:"), parts[0], F.lit(":"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 32), F.lit(">"))


def record_header(kind: Column, url: Column, uri: Column, digest: Column, size: Column, refers: Column, date: str = NO_DATE) -> Column:
    """The exact header text of a record, up to and with the empty line.

    A revisit's block is empty (its payload is the response's), so its Content-Length is 0. A url that a
    header line can't hold (null, or with a line end) has a field of its own, in hex, beside the safe one.
    """
    revisit = kind == "revisit"
    odd = url.isNull() | url.rlike(r"[\r\n]")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), uri),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")),
        F.when(odd, F.concat(F.lit("X-Page-URL: "), F.when(url.isNull(), "null").otherwise(F.concat(F.lit("x"), F.hex(F.encode(url, "UTF-8")))))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), refers)),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def header_url() -> Column:
    """The exact url from a header."""
    own = F.regexp_extract("header", r"\r\nX-Page-URL: (\w+)\r\n", 1)
    safe = F.regexp_extract("header", r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1)
    return F.when(own == "", safe).when(own != "null", F.decode(F.unhex(F.substring(own, 2, 1 << 30)), "UTF-8"))


class WarcArchive:
    """Two tables below one path: ``headers`` (a row for each record) and ``payloads``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")

    def payloads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payloads")

    def verified(self) -> DataFrame:
        """(sha256, payload, payload_bytes, payload_digest), read back; a payload that doesn't match
        its address raises."""
        found = self.payloads().withColumn("again", F.sha2("payload", 256))
        checked = F.when(F.col("again") == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))))
        return found.select("sha256", checked.alias("payload")).select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))

    def rebuilt(self) -> DataFrame:
        """The responses with their payloads: page_id, number, sha256, header, payload."""
        return self.headers().where("record_type = 'response'").join(self.verified().select("sha256", "payload"), "sha256")

    def records(self) -> DataFrame:
        """(page_id, number, record_type, record): the bytes of each record as a WARC file has them.

        Payload bytes meet responses only; a revisit's block is empty.
        """
        end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
        head = F.encode("header", "UTF-8")
        responses = self.rebuilt().select("page_id", "number", "record_type", F.concat(head, F.col("payload"), end).alias("record"))
        return responses.unionByName(self.headers().where("record_type = 'revisit'").select("page_id", "number", "record_type", F.concat(head, end).alias("record")))

    def originals(self) -> DataFrame:
        """(page_id, number, url, payload): every page as it came, revisits too."""
        return self.headers().join(self.verified().select("sha256", "payload"), "sha256").select("page_id", "number", header_url().alias("url"), "payload")

    def digest(self) -> DataFrame:
        """page_id, payload_bytes, payload_digest, record_type, refers_to, from the records rebuilt.

        Size and digest come from the payload of each rebuilt response; a revisit has those of the
        response with its payload, whose page its header names.
        """
        kind = F.regexp_extract("header", r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type")
        refers = F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d+):\w+>\r\n", 1)
        responses = written(self.rebuilt().select("page_id", "sha256", kind, F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest")), "responses")
        facts = responses.groupBy("sha256").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
        revisits = self.headers().where("record_type = 'revisit'").select("page_id", "sha256", kind, F.when(refers != "", refers).cast("long").alias("refers_to")).join(facts, "sha256")
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.select(columns))


def parted(read: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read`` in two: rows whose sha256 certainly is in no other row, and all others. ``rows`` has sha256 and
    n, how many rows of ``read`` each stands for."""
    repeated = rows.groupBy("sha256").agg(F.sum("n").alias("n")).where("n > 1").select("sha256")
    judged = probable(read, "sha256", repeated, repeated.count())
    return judged.where("NOT hit").drop("hit"), judged.where("hit").drop("hit")


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = NO_DATE) -> WarcArchive:
    """Write one record for each row of ``pages`` (page_id, url, html) and give the archive.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest
    page_id is a response and the others revisit it; smaller payloads are all responses. A null html
    is an empty payload; urls come back exactly, null ones too. Rows that repeat a page_id, url and payload
    are told apart by ``number``; of them the first is the smallest. ``date`` is every record's WARC-Date, as
    pages carry none. A null page_id comes after all others. An
    empty table makes an empty archive. Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload().alias("payload"))
    narrow = read.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), base32(F.sha1("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    rows = written(narrow.groupBy("page_id", "url", "sha256", "payload_digest", "payload_bytes").agg(F.count("*").alias("n")), "records")
    # Nulls last: min() skips them, and a group of nulls only has no other.
    place = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", F.coalesce("url", F.lit("")).alias("url_text"), F.col("url").isNull().alias("no_url"))
    first = rows.groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.min(place).alias("first_row"))
    joined = rows.join(first, "sha256").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    is_first = place.eqNullSafe(F.col("first_row")) & (F.col("copy") == 1)
    kind = F.when(~is_first & (F.col("payload_bytes") >= least_bytes), "revisit").otherwise("response")
    judged = joined.withColumn("kind", kind)
    size = F.when(F.col("kind") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    first_url = F.when(~F.col("first_row.no_url"), F.col("first_row.url_text"))
    refers = record_uri(F.col("first_row.page_id"), first_url, F.col("sha256"), F.lit(1))
    header = record_header(F.col("kind"), F.col("url"), record_uri(F.col("page_id"), F.col("url"), F.col("sha256"), F.col("copy")), F.col("payload_digest"), size, refers, date)
    store(judged.select("page_id", F.col("copy").alias("number"), "sha256", F.col("kind").alias("record_type"), header.alias("header")), f"{path}/headers")
    # Bytes of each digest's first record only; those that no other row has are written where they are read.
    # Where repeated rows share that record's page_id, one of them is taken; the others' bytes never go
    # through a second shuffle.
    sole, others = parted(read.withColumn("sha256", F.sha2("payload", 256)), rows)
    alike = rows.groupBy("sha256", "page_id").agg(F.sum("n").alias("n"))
    firsts = alike.groupBy("sha256").agg(F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "n")).alias("f")).select(F.col("sha256").alias("address"), F.col("f.page_id").alias("first_id"), F.col("f.n").alias("alike"))
    chosen = others.join(firsts, (F.col("sha256") == F.col("address")) & F.col("page_id").eqNullSafe(F.col("first_id"))).select("sha256", "payload", "alike")
    once = sole.select("sha256", "payload").unionByName(chosen.where("alike = 1").drop("alike")).unionByName(chosen.where("alike > 1").drop("alike").dropDuplicates(["sha256"]))
    store(once, f"{path}/payloads")
    return WarcArchive(spark, path)


def from_bytes(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; for tests and small reads."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]

"""Content addressing: files, their addresses, and what an address stands for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import ALGORITHMS, SHORT_FORMS, digests, hash_uris, internal_hash, uris_of
from ..storage import few


@dataclass(frozen=True)
class Catalog:
    """The tables of a log; nothing is cached unless the caller does so.

    files(file_id, hash, type, size), uris(uri, file_id), metafiles(meta_file_id, target_uri), metadata(meta_file_id, field,
    value), postings(term, meta_file_id). Those that a reader has not asked for are None.
    """

    files: DataFrame
    uris: DataFrame
    metafiles: DataFrame
    metadata: DataFrame
    postings: DataFrame | None
    #: postings under stems, where the log has them
    stems: DataFrame | None = None
    #: where terms stand: term, meta_file_id, positions (ascending)
    places: DataFrame | None = None
    #: file_id, hash, type, digests: what `uris` follows from, where the log has it; lookups then carry digests, not addresses
    digests: DataFrame | None = None
    #: what targets() gives, where the log keeps it: what an address stands for is asked once a log, not once a query
    resolved: DataFrame | None = None
    #: what metas() gives, where a meta-file and its hash are one row of the log
    said: DataFrame | None = None

    def targets(self) -> DataFrame:
        """meta_file_id, file_id: every file that a meta-file's target address stands for."""
        if self.resolved is not None:
            return self.resolved
        return self.metafiles.join(self.uris, F.col("target_uri") == F.col("uri")).select("meta_file_id", "file_id")

    def metas(self) -> DataFrame:
        """meta_file_id, target_uri, hash of each meta-file."""
        if self.said is not None:
            return self.said
        return self.metafiles.join(self.files.select(F.col("file_id").alias("meta_file_id"), "hash"), "meta_file_id").select("meta_file_id", "target_uri", "hash")

    def standing_for(self, wanted: DataFrame) -> DataFrame:
        """uri, file_id: the files of each address in `wanted` (uri, repeats count once)."""
        if self.digests is not None:
            return lookup(self.digests.select("file_id", "digests"), wanted)
        return wanted.select("uri").distinct().join(self.uris, "uri").select("uri", "file_id")

    def addresses(self) -> DataFrame:
        """file_id, hash, type, addresses (an array) of each file."""
        if self.digests is not None:
            return self.digests.select("file_id", "hash", "type", uris_of(F.col("digests"), _names(self.digests)).alias("addresses"))
        return self.files.select("file_id", "hash", "type").join(self.uris.groupBy("file_id").agg(F.collect_list("uri").alias("addresses")), "file_id")


def _names(held: DataFrame) -> list[str]:
    """Algorithms of a table with a column digests."""
    return held.schema["digests"].dataType.names


def lookup(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """uri and the columns of `held` (digests, ...) but for the digests: the rows whose content has an address in `wanted` (uri).

    A row gives one key for each algorithm that is asked for, the start that all forms of an address share; what meets there is
    compared in full. What is asked for is put down first: few addresses go to the rows, which are not shuffled then. Where they are
    many, a lookup shuffles a digest or so of each row, not all its addresses.
    """
    names, start = _names(held), min(SHORT_FORMS)
    form = r"^hash://([^/]+)/([0-9a-f]+)$"
    parsed = wanted.select("uri").distinct().select("uri", F.regexp_extract("uri", form, 1).alias("algorithm"), F.regexp_extract("uri", form, 2).alias("asked"))
    parsed = parsed.filter(F.col("algorithm").isin(*names))
    asked = few(parsed.withColumn("key", F.unhex(F.substring("asked", 1, start))))
    kinds = [r.algorithm for r in asked.select("algorithm").distinct().collect()] or names[:1]  # as many as there are algorithms at most
    others = [c for c in held.columns if c != "digests"]
    each = F.array(*(F.struct(F.lit(name).alias("algorithm"), F.col("digests")[name].alias("digest")) for name in kinds))
    rows = held.select(*others, F.explode(each).alias("x")).select(*others, "x.*").withColumn("key", F.substring("digest", 1, start // 2))
    hexed, size = F.lower(F.hex("digest")), F.length("asked")
    same = F.startswith(hexed, F.col("asked")) & (size.isin(*SHORT_FORMS) | (size == F.length(hexed)))
    return rows.join(asked, ["algorithm", "key"]).filter(same).select("uri", *others)


def ingest(blobs: DataFrame, algorithms: dict = ALGORITHMS, keep: tuple[str, ...] = ()) -> DataFrame:
    """seq, hash, type, size and digests of non-empty blobs (seq, content, type), and the columns to keep; content stays in the scan stage."""
    content = F.col("content").cast("binary")
    good = blobs.filter(F.octet_length(content) > 0)
    return good.select("seq", internal_hash(content).alias("hash"), "type", F.octet_length(content).cast("long").alias("size"), digests(content, algorithms).alias("digests"), *keep)


def dedup_files(ingested: DataFrame) -> DataFrame:
    """One file per (hash, type), named by its oldest sequence number."""
    return ingested.groupBy("hash", "type").agg(F.min("seq").alias("file_id"), F.min("size").alias("size")).select("file_id", "hash", "type", "size")


def dedup_rows(ingested: DataFrame) -> DataFrame:
    """The oldest whole row of each (hash, type), seq as file_id: one shuffle for all that a log makes of them."""
    others = [c for c in ingested.columns if c not in ("seq", "hash", "type")]
    # dealt by hash first: both halves of the aggregation then run behind the shuffle, and none sorts whole rows before it
    oldest = ingested.repartition("hash").groupBy("hash", "type").agg(F.min_by(F.struct("seq", *others), "seq").alias("x"))
    return oldest.select(F.col("x.seq").alias("file_id"), "hash", "type", *(f"x.{c}" for c in others))


def append_files(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """Files of a batch that the catalogue lacks."""
    return dedup_files(ingested).join(files.select("hash", "type"), ["hash", "type"], "left_anti").select(*files.columns)


def uri_index(ingested: DataFrame) -> DataFrame:
    """uri, file_id of each distinct file; addresses are written out behind the shuffle."""
    found = ingested.groupBy("hash", "type").agg(F.min("seq").alias("file_id"), F.any_value("digests").alias("digests"))
    return written_out(found)


def written_out(held: DataFrame) -> DataFrame:
    """uri, file_id of each address of the files (file_id, digests)."""
    return held.select(F.explode(uris_of(F.col("digests"), _names(held))).alias("uri"), "file_id")


def resolve(uris: DataFrame, wanted: DataFrame) -> DataFrame:
    """uri and the oldest file that has it, for the addresses in `wanted` (uri) that are known."""
    return wanted.select("uri").distinct().join(uris, "uri").groupBy("uri").agg(F.min("file_id").alias("file_id"))


def synonyms(uris: DataFrame, wanted: DataFrame) -> DataFrame:
    """uri, synonym: each wanted address with all addresses of the file it stands for, itself included."""
    own = wanted.select("uri").distinct()
    found = resolve(uris, own).join(uris.withColumnRenamed("uri", "synonym"), "file_id").select("uri", "synonym")
    return found.union(own.select("uri", F.col("uri").alias("synonym"))).distinct()


def verify_known(submitted: DataFrame, known: str = "known_uri", algorithms: dict = ALGORITHMS) -> DataFrame:
    """`submitted` with a column accepted: no address is claimed, or it is one of the content's."""
    uris = hash_uris(F.col("content").cast("binary"), algorithms)
    return submitted.withColumn("accepted", F.coalesce(F.array_contains(uris, F.col(known)), F.lit(True)))


def skip_existing(batch: DataFrame, uris: DataFrame) -> DataFrame:
    return batch.join(uris.select("uri"), "uri", "left_anti")


def provenance(submissions: DataFrame) -> DataFrame:
    return submissions.select("file_id", "session_id").distinct()

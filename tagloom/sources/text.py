"""Text reader messages: framing of chunks into lines, and decoding of one message per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_whitespace
from ..operators.ordering import SLICE_BITS, with_running_total
from ..schema import DECODE_DEFAULT_ANTENNA, DECODE_DEFAULT_RSSI


def split_lines(chunks: DataFrame, *, stream: str = "stream_id", order: str = "chunk_no", data: str = "data",
                keep_tail: bool = True, split_returns: bool = False, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Cut chunked text at newlines into trimmed lines ``(stream, line_no, line)``.

    ``keep_tail`` emits the unfinished last line (socket end of stream) or holds
    it back (serial port).  ``split_returns`` also ends a line at a lone
    carriage return.  Lines inside one chunk never move; only the first and last
    piece of a chunk are shuffled, by line, so a busy stream spreads out.
    """
    pieces = chunks.select(stream, order, F.split(data, "\n", -1).alias("_pieces")) \
        .withColumn("_newlines", F.size("_pieces").cast("bigint") - 1)
    placed = with_running_total(pieces, [stream], F.col("_newlines"), "_before", order=order, inclusive=False,
                                slice_bits=slice_bits)
    parts = placed.select(stream, order, "_newlines", "_before", F.posexplode("_pieces").alias("_at", "_text")) \
        .withColumn("line_no", F.col("_before") + F.col("_at"))
    interior = (F.col("_at") > 0) & (F.col("_at") < F.col("_newlines"))
    whole = parts.where(interior).select(stream, "line_no", F.col("_text").alias("line"))
    joined = parts.where(~interior).groupBy(stream, "line_no").agg(
        F.array_sort(F.collect_list(F.struct(order, "_text"))).alias("_parts"),
        F.max(F.col("_at") < F.col("_newlines")).alias("_ended"))
    text = F.array_join(F.transform("_parts", lambda p: p["_text"]), "")
    kept = joined.where((text != "") | F.col("_ended")) if keep_tail else joined.where("_ended")
    lines = whole.unionByName(kept.select(stream, "line_no", text.alias("line")))
    if split_returns:
        lines = lines.select(stream, "line_no", F.posexplode(F.split("line", "\r", -1)).alias("part_no", "line")) \
            .where(trim_whitespace(F.col("line")) != "")
    return lines.withColumn("line", trim_whitespace(F.col("line")))


def decode_text_lines(df: DataFrame, line: str = "line", *, case_insensitive_keys: bool = False) -> DataFrame:
    """Decode one text message per row into ``epc, tid, rssi, antenna_port``; other columns are kept.

    A message that starts with ``{`` is read as JSON.  A document without an EPC
    yields no row; a document that does not parse, or whose members have the
    wrong type, is taken whole as a plain EPC.  Any other text is a plain EPC,
    and a blank one yields no row.

    The strict parse wraps the text in brackets, so that trailing text breaks
    it, and asks for exactly one element.  Of a repeated key the last value
    counts, which needs the session setting switched on here.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    names = ("epc", "tid", "rssi", "antenna")
    trimmed = df.withColumn("_text", trim_whitespace(F.col(line)))
    document = F.col("_text")
    if case_insensitive_keys:
        for name in names:
            document = F.regexp_replace(document, rf'(?i)"{name}"(\s*:)', f'"{name}"$1')
    parsed = trimmed.withColumn("_doc", F.when(
        F.col("_text").startswith("{"), F.try_parse_json(F.concat(F.lit("["), document, F.lit("]")))))
    single = F.col("_doc").isNotNull() & F.try_variant_get("_doc", "$[1]", "variant").isNull()
    members = parsed.withColumns({"_single": single, **{
        f"_{n}": F.try_variant_get("_doc", f"$[0].{n}", "variant") for n in names}})
    typed = members.withColumns({f"_{n}_kind": F.schema_of_variant(f"_{n}") for n in names})

    def textual(kind: str) -> Column:
        return F.col(kind).isNull() | F.col(kind).isin("STRING", "VOID")

    def numeric(kind: str) -> Column:
        return F.col(kind).isNull() | F.col(kind).isin("BIGINT", "DOUBLE", "FLOAT") | F.col(kind).startswith("DECIMAL")

    valid = F.col("_single") & textual("_epc_kind") & textual("_tid_kind") \
        & numeric("_rssi_kind") & numeric("_antenna_kind")
    judged = typed.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    whole = F.col("_valid") & (F.col("_antenna_kind") == "BIGINT")
    fields = judged.withColumns({
        "_epc_text": F.when(F.col("_valid"), F.try_variant_get("_epc", "$", "string")).otherwise(F.col("_text")),
        "_tid_text": F.when(F.col("_valid"), F.try_variant_get("_tid", "$", "string")),
        "_rssi_number": F.coalesce(F.when(F.col("_valid"), F.try_variant_get("_rssi", "$", "double")),
                                   F.lit(DECODE_DEFAULT_RSSI)).cast("float"),
        "_port": F.coalesce(F.when(whole, F.try_variant_get("_antenna", "$", "int")), F.lit(DECODE_DEFAULT_ANTENNA)),
    })
    read = F.struct(F.col("_epc_text").alias("epc"), F.col("_tid_text").alias("tid"),
                    F.col("_rssi_number").alias("rssi"), F.col("_port").alias("antenna_port"))
    # A filter on the EPC would be pushed below these projections and parse the text again for every
    # reference; a generator stays where it is.
    return fields.select(*[c for c in df.columns if c != line],
                         F.inline(F.when(F.col("_epc_text") != "", F.array(read))))


def decode_mqtt_messages(df: DataFrame, topic: str = "topic", payload: str = "payload", **options) -> DataFrame:
    """Decode broker messages; the topic goes into the metadata map."""
    decoded = decode_text_lines(df, payload, **options)
    return decoded.withColumn("extra_metadata", F.create_map(F.lit("MqttTopic"), F.col(topic))).drop(topic)

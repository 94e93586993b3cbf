"""Queue message codecs: JSON text <-> typed columns.

The service decodes with Go's ``encoding/json``: absent and null fields become
zero values and are *valid*; bad syntax, text after the value, values of another
type and impossible times are errors. Texts are parsed to VARIANT, which keeps
the JSON type of every value, so each field is checked by type; nothing here
throws on any text, and everything is an expression, so a stream decodes like a
table. JSON keys are matched without regard to case, as the service does; a key that
comes twice, in whatever case, is malformed (Go takes the last; a documented
difference).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import NIL_UUID, canonical_uuid
from ..functions.timecols import ntz_from_micros

# fixed value: strict RFC-3339 with any number of fraction digits
RFC3339 = (r"\A\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
           r"(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)\z")
ZERO_TIME = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"

_ROOT = "_kf_v"


def _decode(df: DataFrame, value: str, texts: list[str], ids: list[str] = (), times: list[str] = ()) -> DataFrame:
    """``df`` with the parsed value and, per field, its variant, its JSON type
    (VOID where it is absent or null), its text and what that decodes to.

    The text is parsed once, as the first of two elements; the second is the
    text's own hash. What stands after the value, or closes the array early,
    puts something else in the second place. Each step is a projection of its
    own, so no step's expression is evaluated again by the many uses of its
    result."""
    v = F.col(value)
    tag = F.xxhash64(v)
    d = df.withColumn(_ROOT, F.try_parse_json(F.concat(F.lit("["), v, F.lit(","), tag.cast("string"), F.lit("]"))))
    d = d.withColumn(_ROOT, F.when(F.try_variant_get(F.col(_ROOT), "$[1]", "bigint") == tag, F.try_variant_get(F.col(_ROOT), "$[0]", "variant")))
    members = F.map_entries(F.try_variant_get(F.col(_ROOT), "$", "map<string, variant>"))
    # fixed value: letters outside ASCII that the service's key matching folds to s and k
    folded = lambda key: F.lower(F.translate(key, "\u017f\u212a", "sk"))
    d = d.withColumn("_kf_top", F.transform(members, lambda m: F.struct(folded(m["key"]).alias("k"), m["value"].alias("v"))))
    fields = [*texts, *ids, *times]
    found = lambda f: F.filter("_kf_top", lambda m: m["k"] == F.lit(f))
    d = d.withColumns({f"_kf_f_{f}": found(f) for f in fields})
    d = d.withColumns({"_kf_once": _all([F.coalesce(F.size(f"_kf_f_{f}") <= 1, F.lit(True)) for f in fields]),
                       **{f"_kf_v_{f}": F.get(f"_kf_f_{f}", 0)["v"] for f in fields}})
    d = d.withColumns({f"_kf_k_{f}": F.coalesce(F.schema_of_variant(F.col(f"_kf_v_{f}")), F.lit("VOID")) for f in fields})
    text = lambda f: F.when(F.col(f"_kf_k_{f}") == "STRING", F.try_variant_get(F.col(f"_kf_v_{f}"), "$", "string"))
    d = d.withColumns({f"_kf_s_{f}": text(f) for f in fields})
    return d.withColumns({**{f"_kf_d_{f}": canonical_uuid(F.col(f"_kf_s_{f}")) for f in ids},
                          **{f"_kf_d_{f}": rfc3339_to_ntz(F.col(f"_kf_s_{f}")) for f in times}})


def _object_ok() -> Column:
    """One JSON object without a field twice, or null, which decodes to zero values."""
    return F.col(_ROOT).isNotNull() & F.col("_kf_once") & (F.col("_kf_top").isNotNull() | F.coalesce(F.is_variant_null(F.col(_ROOT)), F.lit(False)))


def _text_ok(field: str) -> Column:
    return F.col(f"_kf_k_{field}").isin("STRING", "VOID")


def _decodes(field: str) -> Column:
    """An id or time field: absent, null, or text of its form."""
    return (F.col(f"_kf_k_{field}") == "VOID") | F.col(f"_kf_d_{field}").isNotNull()


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _result(d: DataFrame, ok: Column, values: dict[str, Column]) -> DataFrame:
    """The values where the message decodes, else null, and ``malformed``."""
    d = d.withColumn("malformed", ~ok)
    d = d.withColumns({n: F.when(~F.col("malformed"), v) for n, v in values.items()})
    return d.drop(*[c for c in d.columns if c.startswith("_kf_")])


def rfc3339_to_ntz(c: Column) -> Column:
    """RFC-3339 text -> UTC TIMESTAMP_NTZ (nanoseconds truncated to micros);
    null for text of another form and for days that do not exist."""
    # read as UTC, then shifted: the cast takes offsets of up to 18 hours only
    utc = c.endswith("Z")
    instant = F.unix_micros(F.when(utc, c).otherwise(F.concat(F.left(c, F.length(c) - 6), F.lit("Z"))).try_cast("timestamp"))
    offset = lambda at: F.substring(F.right(c, F.lit(5)), at, 2).try_cast("long")
    ahead = (offset(1) * 60 + offset(4)) * F.when(F.substring(F.right(c, F.lit(6)), 1, 1) == "-", -60_000_000).otherwise(60_000_000)
    return F.when(c.rlike(RFC3339), ntz_from_micros(F.when(utc, instant).otherwise(instant - ahead)))


#: Fields of a request message that hold text, besides its id and times.
_REQUEST_TEXTS, _REQUEST_TIMES = ["sid", "cid", "org"], ["ts", "crt"]


def request_ok() -> Column:
    """Whether the decoded text is a request message."""
    return _all([_object_ok(), _decodes("rid"), *map(_text_ok, _REQUEST_TEXTS), *map(_decodes, _REQUEST_TIMES)])


def batch_ok() -> Column:
    """Whether it is a batch message: every member of ``rids`` must be an id."""
    kind = F.col("_kf_k_rids")
    members = F.try_variant_get(F.col("_kf_v_rids"), "$", "array<variant>")
    an_id = lambda x: (F.schema_of_variant(x) == "VOID") | (
        (F.schema_of_variant(x) == "STRING") & canonical_uuid(F.try_variant_get(x, "$", "string")).isNotNull())
    listed = (kind == "VOID") | (kind.startswith("ARRAY") & F.coalesce(F.forall(members, an_id), F.lit(False)))
    return _all([_object_ok(), _decodes("bid"), listed])


def decoded_id(field: str) -> Column:
    return F.coalesce(F.col(f"_kf_d_{field}"), F.lit(NIL_UUID))


def parse_requests(df: DataFrame, value: str = "value") -> DataFrame:
    """A2: request messages; adds ``rid, stream_id, cid, origin, ts, crt,
    malformed``. Absent fields take Go zero values."""
    text = lambda f: F.coalesce(f"_kf_s_{f}", F.lit(""))
    time = lambda f: F.coalesce(f"_kf_d_{f}", F.expr(ZERO_TIME))
    d = _decode(df, value, _REQUEST_TEXTS, ["rid"], _REQUEST_TIMES)
    return _result(d, request_ok(), {"rid": decoded_id("rid"), "stream_id": text("sid"), "cid": text("cid"), "origin": text("org"),
                                     "ts": time("ts"), "crt": time("crt")})


def parse_status(df: DataFrame, value: str = "value") -> DataFrame:
    """A3: status messages; adds ``rid, sts, malformed`` (absent sts = 0; a
    whole number from 0 to 255 otherwise)."""
    d = _decode(df, value, ["sts"], ["rid"])
    d = d.withColumn("_kf_n", F.try_variant_get(F.col("_kf_v_sts"), "$", "bigint"))
    kind = F.col("_kf_k_sts")
    number = (kind == "VOID") | ((kind == "BIGINT") & F.coalesce(F.col("_kf_n").between(0, 255), F.lit(False)))
    return _result(d, _all([_object_ok(), _decodes("rid"), number]), {
        "rid": decoded_id("rid"), "sts": F.coalesce("_kf_n", F.lit(0)).try_cast("smallint")})


def parse_batch(df: DataFrame, value: str = "value") -> DataFrame:
    """Batch messages ``{bid, rids}``; adds ``bid, malformed``."""
    d = _decode(df, value, ["rids"], ["bid"])
    return _result(d, batch_ok(), {"bid": decoded_id("bid")})


def request_or_batch(df: DataFrame, value: str = "value") -> DataFrame:
    """Both readings of a text from one parse: ``rid`` and ``bid``, null
    where it is no such message."""
    d = _decode(df, value, [*_REQUEST_TEXTS, "rids"], ["rid", "bid"], _REQUEST_TIMES)
    d = d.withColumns({"rid": F.when(request_ok(), decoded_id("rid")), "bid": F.when(batch_ok(), decoded_id("bid"))})
    return d.drop(*[c for c in d.columns if c.startswith("_kf_")])


def rfc3339_text(ts: Column) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) -> RFC-3339 text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def encode_request(rid: Column, stream_id: Column, cid: Column, origin: Column,
                   ts: Column, crt: Column) -> Column:
    """Request message JSON with the wire field names."""
    return F.to_json(F.struct(rid.alias("rid"), stream_id.alias("sid"), cid.alias("cid"),
                              origin.alias("org"), rfc3339_text(ts).alias("ts"),
                              rfc3339_text(crt).alias("crt")))


def encode_status(rid: Column, sts: Column) -> Column:
    return F.to_json(F.struct(rid.alias("rid"), sts.alias("sts")))


def encode_batch(bid: Column, rids: Column) -> Column:
    return F.to_json(F.struct(bid.alias("bid"), rids.alias("rids")))

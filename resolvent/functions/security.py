"""Request validation, addresses, signatures and tokens as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _col, let

_OCTET = "(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_IPV4 = f"^{_OCTET}(\\.{_OCTET}){{3}}$"


def fresh(stamp: Column | str, now: Column | str, window: int = 60) -> Column:
    """Whether a stamp (seconds, as text or number) lies within ``window`` of now, both ways; false if it is no number."""
    return F.coalesce(F.abs(_col(now).cast("double") - _col(stamp).cast("string").try_cast("double")) <= window, F.lit(False))


def is_ip(c: Column | str) -> Column:
    """IPv4 of four octets without leading zeros, or IPv6 of eight groups, fewer with one ``::``; an IPv4 address at the
    end stands for two groups."""
    return let(_col(c), lambda x: F.coalesce(x.rlike(_IPV4) | (F.contains(x, F.lit(":")) & let(F.split(x, "::"), _is_ipv6)), F.lit(False)))


def _is_ipv6(halves: Column) -> Column:
    """Whether the parts of a text around ``::`` make an IPv6 address."""
    groups = F.flatten(F.transform(halves, lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":"))))

    def valid(every: Column) -> Column:
        quad = F.coalesce(F.get(every, F.size(every) - 1).rlike(_IPV4), F.lit(False))
        hexes = F.slice(every, F.lit(1), F.size(every) - quad.cast("int"))
        count = F.size(every) + quad.cast("int")
        return F.forall(hexes, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")) & F.when(F.size(halves) == 2, count <= 7).otherwise((F.size(halves) == 1) & (count == 8))

    return let(groups, valid)


def normalise_ip(c: Column | str) -> Column:
    """An address without brackets, IPv4 port and zone; null where none is left."""
    bare = lambda x: F.when(x.startswith("["), F.nullif(F.regexp_extract(x, "^\\[([^\\]]*)\\]", 1), F.lit(""))).when(F.contains(x, F.lit(".")) & (F.size(F.split(x, ":")) == 2), F.get(F.split(x, ":"), F.lit(0))).otherwise(x)
    address = let(F.trim(_col(c)), lambda x: F.get(F.split(bare(x), "%"), F.lit(0)))
    return let(address, lambda x: F.when(is_ip(x), x))


def client_ip(forwarded: Column | str, transport: Column | str) -> Column:
    """The rightmost hop of a forwarded list, after the transport's own hop at its end is peeled off a longer list; the
    transport address (``no-ip`` without one) where that hop is malformed or there is none: a caller cannot choose it."""
    own = F.nullif(_col(transport), F.lit(""))

    def last(hops: Column) -> Column:
        peel = F.coalesce((F.size(hops) > 1) & (F.get(hops, F.size(hops) - 1) == own), F.lit(False))
        return F.get(hops, F.size(hops) - 1 - peel.cast("int"))

    hops = F.filter(F.transform(F.split(F.coalesce(_col(forwarded), F.lit("")), ","), lambda h: F.trim(h)), lambda h: h != "")
    return F.coalesce(normalise_ip(let(hops, last)), own, F.lit("no-ip"))


def canonical_messages(params: DataFrame, key: str = "request", name: str = "name", value: str = "value") -> DataFrame:
    """``params(request, name, value, ord)`` -> ``(request, message)``: names sorted, values of one name joined by commas in
    order, pairs without separators; the signature is left out."""
    joined = params.where(F.col(name) != "signature").groupBy(key, name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", value))), lambda s: s[value]), ",").alias("_v"))
    pairs = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col("_v").alias("v")))).alias("_p"))
    return pairs.select(key, F.array_join(F.transform("_p", lambda s: F.concat(s.n, F.lit("="), s.v)), "").alias("message"))


def hmac_sha256(message: Column | str, secret: bytes) -> Column:
    """HMAC-SHA256 of a text as lower-case hex, by two nested hashes over the padded key."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), _col(message).cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def base64url(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(c), "+/", "-_"), "[=\\r\\n]+", "")


def unbase64url(c: Column) -> Column:
    x = F.translate(c, "-_", "+/")
    return F.try_to_binary(F.rpad(x, F.length(x) + F.pmod(-F.length(x), F.lit(4)), "="), F.lit("base64"))


CLAIMS = "v INT, cid STRING, product STRING, role STRING, sf STRING, iat BIGINT, exp BIGINT"


def encode_token(claims: Column, secret: bytes) -> Column:
    """``payload.signature`` of a struct of claims."""
    body = base64url(F.to_json(claims).cast("binary"))
    return F.concat(body, F.lit("."), base64url(F.unhex(hmac_sha256(body, secret))))


def verify_token(token: Column | str, now: Column, secret: bytes, version: int = 1, ttl: int = 300, skew: int = 60) -> Column:
    """Struct of ``claims`` and ``reason``: the first rule that fails (malformed, bad_signature, bad_token_version,
    bad_expiry, iat_in_future, expired, ttl_too_long), or null.  The skew is for the time of issue alone."""
    parts = F.split(_col(token), "\\.")
    body, signature = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    text = unbase64url(body).cast("string")
    claims = F.from_json(text, CLAIMS.replace("v INT", "v DOUBLE").replace("BIGINT", "DOUBLE"))
    reason = (
        F.when(_col(token).isNull() | (F.size(parts) != 2) | (body == "") | (signature == ""), "malformed")
        .when(signature != base64url(F.unhex(hmac_sha256(body, secret))), "bad_signature")
        .when(~F.coalesce(F.get_json_object(text, "$").rlike("^[{\\[]"), F.lit(False)), "malformed")
        .when(~claims["v"].eqNullSafe(F.lit(float(version))), "bad_token_version")
        .when(claims["iat"].isNull() | claims["exp"].isNull(), "malformed")
        .when(claims["exp"] < claims["iat"], "bad_expiry")
        .when(claims["iat"] > now + skew, "iat_in_future")
        .when(claims["exp"] < now, "expired")
        .when(claims["exp"] - claims["iat"] > ttl + skew, "ttl_too_long")
    )
    return F.struct(F.when(reason.isNull(), F.from_json(text, CLAIMS)).alias("claims"), reason.alias("reason"))


#: Fields of the two requests; sessions are untrusted, bounded text.
SPECIFICATION_FIELDS = ("product", "role", "botanical", "session_id", "candidate_format")
PROCUREMENT_FIELDS = ("specification_token", "session_id")
_SESSION = "^[A-Za-z0-9_-]{1,64}$"


def _fields_and(keys: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(keys.isNull(), "bad_body").when(F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0, "unexpected_field")


def validate_request(keys: Column, product: Column, role: Column, botanical: Column, session: Column, code: Column, codes: tuple[str, ...], known_cell: Column, allowed: tuple[str, ...] = SPECIFICATION_FIELDS) -> Column:
    """First failing reason of a specification request, or null.  ``keys`` are the request's fields (null: no object);
    ``known_cell`` says whether product and role are a cell, which is an outcome of its own, after all others."""
    return (
        _fields_and(keys, allowed)
        .when(product.isNull() | role.isNull(), "missing_product_role")
        .when((F.coalesce(F.trim(botanical), F.lit("")) == "") | (F.length(botanical) > 80), "bad_botanical")
        .when(session.isNotNull() & ~session.rlike(_SESSION), "bad_session")
        .when(code.isNotNull() & ~code.isin(*codes), "bad_candidate_format")
        .when(~F.coalesce(known_cell, F.lit(False)), "unknown_product_role")
    )


def validate_procurement(keys: Column, token: Column, session: Column, allowed: tuple[str, ...] = PROCUREMENT_FIELDS) -> Column:
    """First failing reason of a procurement request, or null."""
    return _fields_and(keys, allowed).when(F.coalesce(token, F.lit("")) == "", "missing_token").when(session.isNotNull() & ~session.rlike(_SESSION), "bad_session")


def well_formed(c: Column | str) -> Column:
    """Structural audit of a scientific name: a capital genus of two letters or more, then small epithets or hybrid signs."""
    return F.coalesce(F.trim(_col(c)).rlike("^[A-Z][a-zA-Z-]+(\\s+([×x]|×?[a-z][a-zà-ÿ-]*))*$"), F.lit(False))


#: Spaces that are not the ordinary one.
_ODD_SPACE = "[\\x{A0}\\x{202F}\\x{FEFF}\\x{2000}-\\x{200A}]"


def name_features(c: Column | str) -> Column:
    """Struct of audit flags: ``nbsp`` (any space that is not the ordinary one), ``padded, non_ascii, author, hyphen_epithet`` (a
    hyphen inside any word but the first)."""
    x = F.coalesce(_col(c), F.lit(""))
    return F.struct(
        x.rlike(_ODD_SPACE).alias("nbsp"), x.rlike("^\\s|\\s$|\\s{2,}").alias("padded"),
        x.rlike("[^\\x00-\\x7F×]").alias("non_ascii"), x.rlike("\\([A-Z][a-zà-ÿ'.-]*\\.?\\)|\\b[A-Z][a-z]*\\.(\\s|$)").alias("author"), x.rlike("^[^ ]* .*\\S-\\S").alias("hyphen_epithet"),
    )

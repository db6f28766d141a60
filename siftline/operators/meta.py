"""What a value tells besides being a secret: claims of a JWT, the user and host of a URL or connection string."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.predicates import connection_string

#: Keys of connection strings, by field.
KEYS = {"username": ["username", "user id", "uid", "user"], "host": ["data source", "server", "host"], "client_id": ["client id", "clientid", "client_id", "appid"], "client_key": ["client secret", "clientsecret", "client_key"]}
#: From the mark of any encoded JSON object to a blank or quote.
TOKEN = r"""eyJ[^ \t\r\n"']*"""


def segment(token: Column, i: int) -> Column:
    """The text of a base64url segment, or null."""
    part = F.try_element_at(F.split(token, r"\."), F.lit(i))
    padded = F.rpad(F.translate(part, "-_", "+/"), (F.ceil(F.length(part) / 4) * 4).cast("int"), "=")
    valid = part.rlike(r"^[A-Za-z0-9_-]+={0,2}\z")
    return F.when(valid & (F.length(part) % 4 != 1), F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8"))


def jwt(value: Column) -> Column:
    """(header, claims) as JSON texts, or null; claims have to be an object."""
    token = F.regexp_extract(text.normalize(value), TOKEN, 0)

    def of(t: Column) -> Column:
        header, claims = segment(t, 1), segment(t, 2)
        good = F.startswith(F.ltrim(claims), F.lit("{")) & F.try_parse_json(claims).isNotNull()
        return F.when(good, F.concat_ws("\0", F.coalesce(header, F.lit("")), claims))

    return F.when(token != "", text.let(token, of))


def claims(packed: str | None, now: float) -> dict | None:
    """The JWT part of a finding from what jwt() packed, or None if there is nothing to tell."""
    if not packed:
        return None
    header, body = packed.split("\0", 1)
    try:
        body = json.loads(body)
        header = json.loads(header) if header else {}
    except ValueError:
        header = {}
        if not isinstance(body, dict):
            return None
    if not isinstance(body, dict):
        return None
    number = lambda k: int(body[k]) if isinstance(body.get(k), (int, float)) and not isinstance(body.get(k), bool) and body[k] else 0
    issuer = body.get("iss") if isinstance(body.get("iss"), str) else ""
    issued, expires = number("iat"), number("exp")
    extra = {k: v for k, v in body.items() if k not in ("iss", "iat", "exp")}
    header = header if isinstance(header, dict) else {}
    out = {"issuer": issuer, "iat": issued, "expiration": expires, "is_expired": bool(expires and expires < now), "header": header, "extra": extra}
    return {k: v for k, v in out.items() if v} or None


def connection(value: Column, field: str) -> Column:
    """The first value given under one of the field's keys, or null."""
    pairs = F.filter(F.split(value, ";"), lambda x: x.rlike("[=:]"))
    key = lambda x: F.lower(text.trim(F.regexp_extract(x, "(?s)^([^=:]*)[=:]", 1)))
    own = F.filter(pairs, lambda x: key(x).isin(*KEYS[field]))
    values = F.filter(F.transform(own, lambda x: text.trim(F.regexp_extract(x, "(?s)^[^=:]*[=:](.*)$", 1))), lambda v: v != "")
    return F.when(connection_string(value), F.try_element_at(values, F.lit(1)))


def with_meta(findings: DataFrame) -> DataFrame:
    """Add jwt (packed), username, host, url, client_id, client_key, and has_meta where a URL or connection string fills any."""
    raw = F.col("raw_value")
    normal = text.normalize(raw)
    user = urls.is_url(normal) & urls.userinfo(normal)
    from_url = {"username": F.when(user, F.when(urls.username(normal) != "", urls.username(normal))), "host": F.when(user, urls.host(normal)), "url": F.when(user, normal)}
    out = findings.withColumns({f: F.coalesce(from_url.get(f, F.lit(None).cast("string")), connection(raw, f)) for f in KEYS} | {"url": from_url["url"], "jwt": jwt(raw)})
    return out.withColumn("has_meta", user | F.coalesce("username", "host", "client_id", "client_key").isNotNull())

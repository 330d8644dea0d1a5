"""Format-preserving pseudonyms for personal data, as SQL expressions alone.

Card numbers (13 to 19 digits), phone numbers, social security numbers, IPv4 addresses, dates and
e-mail addresses are found by one pattern and checked.  Their digits go through a keyed Feistel
network over Z_a x Z_b, a permutation of all values of one format: cards keep their length,
separators and Luhn validity or invalidity, dates stay dates of 1900 to 2099 in their own notation
(17 x 4297 days, exactly), addresses stay addresses.  Equal values get equal pseudonyms in every
document, whatever their separators.  Letters and digits of a mail address's local part are replaced
from a keyed digest; its domain becomes ``masked.example``.

The key is a secret that callers must pass; the queries' own default only serves the tests.

Defined results: null text stays null; text without finds is returned unchanged; invalid dates and
addresses are left; equal texts give equal values; rows and extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
TEST_KEY = "test-only-key"
DAYS = (17, 4297)  # 1900-01-01 to 2099-12-31 are 73,049 = 17 x 4297 days
_FIRST_DAY = "1900-01-01"

_MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"
_DATE = r"(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9./-]*[0-9])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9-])"
_CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?)(?![0-9A-Za-z])"
KINDS = {"email": _MAIL, "ip": _IP, "date": _DATE, "ssn": _SSN, "phone": _PHONE, "card": _CARD}
#: A find starts behind neither a letter nor a digit, dot or hyphen that would belong to it.
PATTERN = rf"(?<![A-Za-z0-9])(?<![0-9][.-])(?:{'|'.join(KINDS.values())})"


def _round(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """A keyed 52-bit number."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """Struct (l, r) of a keyed permutation of Z_a x Z_b; ``inverse`` undoes it.

    The halves take turns: one grows by a keyed function of the other, modulo its own size.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if inverse else 1

    def step(s: Column, i: Column) -> Column:
        new_l = F.pmod(s["l"] + sign * (_round(key, tweak, i, s["r"]) % a), a)
        new_r = F.pmod(s["r"] + sign * (_round(key, tweak, i, s["l"]) % b), b)
        return F.when(i % 2 == 0, F.struct(new_l.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), new_r.alias("r")))

    return F.aggregate(turns, start, step)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), 0)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def permute_digits(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    u, v = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    tweak = F.concat(F.lit(kind), n.cast("string"))
    halves = feistel(F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1).cast("long"), _ten_to(u), _ten_to(v), key, tweak, inverse)
    return _let(halves, lambda s: F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), v, "0")))


def luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Luhn's sum of a digit string, from its right end."""
    chars = F.split(F.reverse(digits), "")
    parity = 0 if last_doubled else 1

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == parity, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), term), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return luhn_sum(digits, False) % 10 == 0


def permute_card(digits: Column, key: str, inverse: bool = False) -> Column:
    """The check digit keeps its distance from the valid one; all other digits are permuted."""
    n = F.length(digits)
    body = F.substr(digits, F.lit(1), n - 1)
    distance = F.pmod(F.substr(digits, n).cast("int") + luhn_sum(body, True), F.lit(10))

    def close(new: Column) -> Column:
        return F.concat(new, F.pmod(distance - luhn_sum(new, True), F.lit(10)).cast("string"))

    return _let(permute_digits(body, key, "card", inverse), close)


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by ``digits``, one by one."""
    seen = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.struct(F.substr(form, i, F.lit(1)).alias("c"), F.length(F.regexp_replace(F.substr(form, F.lit(1), i), "[^0-9]", "")).alias("k")))
    return _let(digits, lambda d: F.array_join(F.transform(seen, lambda s: F.when(s["c"].rlike("[0-9]"), F.substr(d, s["k"], F.lit(1))).otherwise(s["c"])), ""))


def _parsed_date(token: Column) -> Column:
    form = F.when(token.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(token.contains("/"), F.when(F.substr(token, F.lit(4), F.lit(2)).cast("int") > 12, "MM/dd/yyyy").otherwise("dd/MM/yyyy")).otherwise("dd.MM.yyyy")
    text = (
        F.when(form == "yyyy-MM-dd", token)
        .when(form == "MM/dd/yyyy", F.concat_ws("-", F.substr(token, F.lit(7)), F.substr(token, F.lit(1), F.lit(2)), F.substr(token, F.lit(4), F.lit(2))))
        .otherwise(F.concat_ws("-", F.substr(token, F.lit(7)), F.substr(token, F.lit(4), F.lit(2)), F.substr(token, F.lit(1), F.lit(2))))
    )
    return F.struct(form.alias("form"), text.try_cast("date").alias("day"))


def permute_date(token: Column, key: str, inverse: bool = False) -> Column:
    """A date of 1900 to 2099 in the same notation; other strings are left.

    ``dd/MM`` is read first; where only ``MM/dd`` is possible the pseudonym is moved to a day above
    12 by walking the permutation on, so that it is read back alike.
    """
    a, b = DAYS

    def day_of(index: Column) -> Column:
        s = feistel(F.floor(index / b).cast("long"), (index % b).cast("long"), F.lit(a), F.lit(b), key, F.lit("date"), inverse)
        return _let(s, lambda x: x["l"] * b + x["r"])

    def written(d: Column) -> Column:
        index = F.datediff(d["day"], F.lit(_FIRST_DAY).cast("date")).cast("long")

        def walk(form: Column) -> Column:
            # A permutation's cycle returns to the start, so walking ends at a day above 12.
            moved = F.aggregate(
                F.sequence(F.lit(1), F.lit(400)),
                F.struct(index.alias("at"), F.lit(False).alias("done")),
                lambda s, i: F.when(s["done"], s).otherwise(
                    _let(day_of(s["at"]), lambda x: F.struct(x.alias("at"), ((form != "MM/dd/yyyy") | (F.dayofmonth(F.date_add(F.lit(_FIRST_DAY).cast("date"), x.cast("int"))) > 12)).alias("done")))
                ),
            )
            return F.date_add(F.lit(_FIRST_DAY).cast("date"), moved["at"].cast("int"))

        def write(day: Column) -> Column:
            y, m, n = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
            return (
                F.when(d["form"] == "yyyy-MM-dd", F.concat_ws("-", y, m, n))
                .when(d["form"] == "MM/dd/yyyy", F.concat_ws("/", m, n, y))
                .when(d["form"] == "dd/MM/yyyy", F.concat_ws("/", n, m, y))
                .otherwise(F.concat_ws(".", n, m, y))
            )

        return F.when(d["day"].isNull(), token).otherwise(_let(walk(d["form"]), write))

    return _let(_parsed_date(token), written)


def permute_ip(token: Column, key: str, inverse: bool = False) -> Column:
    o = [F.split_part(token, F.lit("."), F.lit(i)).cast("long") for i in range(1, 5)]
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"), inverse)
    return _let(s, lambda x: F.concat_ws(".", *[p.cast("string") for h in ("l", "r") for p in (F.floor(x[h] / 256), x[h] % 256)]))


def mask_mail(token: Column, key: str) -> Column:
    """Local part: class by class from a keyed digest of the whole address; domain: one for all."""
    local = F.substring_index(token, "@", 1)
    source = F.concat(*[F.sha2(F.concat_ws(":", F.lit(key), F.lit(f"mail{i}"), F.lower(token)), 256) for i in (0, 1)])
    letters, digits = F.translate(source, "0123456789", "ghijklmnop"), F.translate(source, "abcdef", "012345")

    def char(c: Column, i: Column) -> Column:
        picked = F.when(c.rlike("[0-9]"), F.substr(digits, i + 1, F.lit(1))).otherwise(F.substr(letters, i + 1, F.lit(1)))
        return F.when(c.rlike("[A-Za-z0-9]"), picked).otherwise(c)

    return F.concat(F.array_join(F.transform(F.split(local, ""), char), ""), F.lit("@masked.example"))


def kind_of(token: Column) -> Column:
    out = F.lit("card")
    for kind in reversed(list(KINDS)[:-1]):
        out = F.when(token.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def pseudonym(token: Column, key: str) -> Column:
    """The replacement of one find."""
    digits = F.regexp_replace(token, "[^0-9]", "")
    # A country code stays, so the number keeps its country's format.
    code = F.coalesce(F.regexp_extract(token, r"^\+[0-9]{1,3}(?=[^0-9])[ .-]?", 0), F.lit(""))
    rest = F.substr(token, F.length(code) + 1)
    kind = kind_of(token)
    phone = F.concat(code, refill(rest, permute_digits(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))
    return (
        F.when(kind == "email", mask_mail(token, key))
        .when(kind == "ip", permute_ip(token, key))
        .when(kind == "date", permute_date(token, key))
        .when(kind == "ssn", refill(token, permute_digits(digits, key, "ssn")))
        .when(kind == "phone", phone)
        .otherwise(refill(token, permute_card(digits, key)))
    )


def pseudonymise(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``counts`` adds ``pii`` (kinds found, in order)."""
    if "text" not in docs.columns:
        raise ValueError("missing columns: text")
    columns = docs.columns
    # Struct fields keep the caller's columns apart from the working ones, whatever their names.
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    text = F.col("row").getField("text")
    found = kept.select("row", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("found"))
    gaps = F.when(F.size("found") > 0, F.split(text, PATTERN, -1))
    split = found.select("row", "found", gaps.alias("gaps"), F.transform("found", lambda t: pseudonym(t, key)).alias("new"))
    # One gap more than finds; the last gap has nothing behind it.
    joined = F.array_join(F.flatten(F.zip_with("gaps", "new", lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))), "")
    out = [F.coalesce(F.when(F.size("found") > 0, joined), text).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns]
    if counts:
        out.append(F.coalesce(F.transform("found", kind_of), F.array().cast("array<string>")).alias("pii"))
    return split.select(*out)


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    done = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), TEST_KEY, counts=True)
    n = [(F.size("pii") - F.size(F.array_remove("pii", kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", "text", *n)

"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Matches are found by one pattern, validated by the rules of their kind (Luhn, IBAN modulo 97, calendar, octet range, issued
number ranges), and replaced. Numbers and dates go through a keyed Feistel network over exactly the set of valid values
of their format (dates by walking on from numbers that are no day), so a pseudonym is valid too, equal values get equal pseudonyms in every document, and the key's holder can
undo it. A round adds a keyed SHA-256 value to one half modulo that half's size, so any product of two sizes is
permuted without leaving it. The local part of an e-mail address has no fixed format and gets a keyed digest.

Defined results: a null text stays null, text outside matches stays byte for byte, what fails validation stays;
repeated rows get equal results; an empty table gives an empty result; an empty key is refused. Matches are looked for only in texts
that hold a digit or an @, which every kind needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh

ROUNDS = 10
KINDS = ("email", "card", "iban", "phone", "ip", "ssn", "date")
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31
DAYS_A, DAYS_B = 319, 229  # the network's halves: two numbers more than there are days, and those are walked past

# Fixed formats, as regular expressions. Each begins where no letter or digit stands before it, and has bounded repeats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}(?=[Tt](?![A-Za-z_])|(?![\w/-]|\.\d))|(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d))"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = (
    r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}[ .-]?\d{1,2}(?:[ .-]\d{2}){4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,3}(?!\w|[.,]?\d)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])"
)
# Countries of the IBAN registry by the length of their numbers. Others, and lengths that aren't their country's, match by the last alternative.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    spaced = rf"(?: [A-Z0-9]{{4}}){{{groups}}}" + (rf" [A-Z0-9]{{{rest}}}" if rest else "")
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})(?!\w)"


IBAN = (
    r"(?<!\w)(?=[A-Z]{2}\d{2})(?:" + "|".join(_iban(n, c) for n, c in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w))"
)
CARD = r"(?<![\w])(?:\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"
ANY = "|".join((EMAIL, DATE, IP, SSN, PHONE, IBAN, CARD))


def _round(key: str, kind: str | Column, number: Column, value: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, number.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, sizes: tuple, key: str, kind: str | Column) -> Column:
    """struct(l, r): the image of (left, right) under a keyed permutation of range(sizes[0]) x range(sizes[1])."""
    a, b = (n if isinstance(n, Column) else F.lit(n).cast("bigint") for n in sizes)
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(now: Column, i: Column) -> Column:
        l, r = now["l"], now["r"]
        return F.when(i % 2 == 0, F.struct(((l + _round(key, kind, i, r) % a) % a).alias("l"), r.alias("r"))).otherwise(
            F.struct(l.alias("l"), ((r + _round(key, kind, i, l) % b) % b).alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _long(digits: Column) -> Column:
    return F.coalesce(F.when(digits != "", digits).cast("bigint"), F.lit(0).cast("bigint"))


def _pad(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _refill(shape: Column, digits: Column, start: int = 1) -> Column:
    """shape with its digits, from the start-th on, replaced by digits in order."""
    cells = F.filter(F.split(shape, ""), lambda c: c != "")
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("seen"), F.lit(1).alias("at"))

    def step(now: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        swap = digit & (now["seen"] >= start)
        return F.struct(
            F.concat(now["out"], F.when(swap, F.substring(digits, now["at"], F.lit(1))).otherwise(c)).alias("out"),
            (now["seen"] + digit.cast("int")).alias("seen"),
            (now["at"] + swap.cast("int")).alias("at"),
        )

    return F.aggregate(cells, begin, step, lambda now: now["out"])


def permute_digits(digits: Column, key: str, kind: str, most: int = 30) -> Column:
    """Digits of one length permuted among themselves: all of up to `most`, which no format here exceeds and whose halves fit
    a bigint with a round's value added."""

    def build(d: Column) -> Column:
        size = F.length(d)
        n = F.least(size, F.lit(most))
        half = F.floor(n / 2).cast("int")
        left, right = F.substring(d, size - n + 1, n - half), F.substring(d, size - half + 1, half)
        ten = F.lit(10.0)
        out = feistel(_long(left), _long(right), (F.pow(ten, n - half).cast("bigint"), F.pow(ten, half).cast("bigint")), key, F.concat(F.lit(kind), n.cast("string")))
        return _bind(out, lambda x: F.concat(F.substring(d, F.lit(1), size - n), _pad(x["l"], n - half), F.when(half > 0, _pad(x["r"], half)).otherwise("")))

    return _bind(digits, build)


def luhn_sum(digits: Column) -> Column:
    """Of digits to which a check digit is still to be added, or with 0 in its place."""
    cells = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(cells, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2 % 10) + (c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def valid_card(text: Column) -> Column:
    digits = _digits(text)
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0) & ~digits.rlike("^0+$")


def new_card(text: Column, key: str) -> Column:
    """Same length, separators and first digit, other digits permuted, Luhn digit computed anew."""

    def build(digits: Column) -> Column:
        first = F.substring(digits, 1, 1)
        body = F.concat(first, permute_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
        return _bind(body, lambda b: _refill(text, F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    return _bind(_digits(text), build)


def _mod97(chars: Column) -> Column:
    """Of letters and digits, letters counting 10 to 35."""
    cells = F.filter(F.split(chars, ""), lambda c: c != "")
    return F.aggregate(
        cells, F.lit(0).cast("bigint"),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("bigint")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def valid_iban(text: Column) -> Column:
    plain = F.regexp_replace(text, " ", "")
    size = F.length(plain)
    return size.between(15, 34) & (_mod97(F.concat(F.substring(plain, F.lit(5), size), F.substring(plain, 1, 4))) == 1)


def new_iban(text: Column, key: str) -> Column:
    """Same country, spacing and letters; account digits permuted, check digits computed anew."""

    def build(plain: Column) -> Column:
        bban = F.substring(plain, F.lit(5), F.length(plain))
        moved = _bind(bban, lambda b: _refill(b, permute_digits(_digits(b), key, "iban")))
        country = F.substring(plain, 1, 2)
        return _bind(
            moved,
            lambda b: _refill_all(text, F.concat(country, _pad(98 - _mod97(F.concat(b, country, F.lit("00"))), 2), b)),
        )

    return _bind(F.regexp_replace(text, " ", ""), build)


def _refill_all(shape: Column, chars: Column) -> Column:
    """chars with spaces put where shape has them."""
    cells = F.filter(F.split(shape, ""), lambda c: c != "")
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        cells, begin,
        lambda now, c: F.when(c == " ", F.struct(F.concat(now["out"], c).alias("out"), now["at"].alias("at"))).otherwise(
            F.struct(F.concat(now["out"], F.substring(chars, now["at"], F.lit(1))).alias("out"), (now["at"] + 1).alias("at"))
        ),
        lambda now: now["out"],
    )


def valid_phone(text: Column) -> Column:
    digits = _digits(text)
    return F.length(digits).between(7, 15) & ~digits.rlike("^0+$")


def new_phone(text: Column, key: str) -> Column:
    """Same country code, length and punctuation. Numbers of the North American plan stay within it."""
    code = F.regexp_extract(text, r"^\+(1(?=[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}$)|\d{1,3})", 1)

    def build(digits: Column) -> Column:
        rest = F.substring(digits, F.length(code) + 1, F.length(digits))
        nanp = rest.rlike(r"^[2-9]\d{2}[2-9]\d{6}$") & code.isin("", "1")
        own = feistel(_long(F.substring(rest, 1, 3)) - 200, _long(F.substring(rest, 4, 7)) - 2_000_000, (800, 8_000_000), key, "nanp")
        new = F.when(nanp, _bind(own, lambda x: F.concat((x["l"] + 200).cast("string"), (x["r"] + 2_000_000).cast("string")))).otherwise(permute_digits(rest, key, "phone"))
        return F.concat(F.substring(text, F.lit(1), F.length(code) + F.when(code != "", 1).otherwise(0)), _bind(new, lambda n: _refill(F.substring(text, F.length(code) + F.when(code != "", 2).otherwise(1), F.length(text)), n)))

    return _bind(_digits(text), build)


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda c: c.cast("bigint"))


def valid_ip(text: Column) -> Column:
    return F.forall(_octets(text), lambda x: x <= 255) & ~text.rlike(r"(^|\.)0\d")


def new_ip(text: Column, key: str) -> Column:
    def build(o: Column) -> Column:
        out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ip")
        return _bind(out, lambda x: F.concat_ws(".", *[v.cast("bigint").cast("string") for h in (x["l"], x["r"]) for v in (F.floor(h / 256), h % 256)]))

    return _bind(_octets(text), build)


def valid_ssn(text: Column) -> Column:
    return ~text.rlike(r"^(000|666|9)|-00-|-0000$")


def new_ssn(text: Column, key: str) -> Column:
    """Within issued areas (1-665, 667-899), groups 1-99 and serials 1-9999."""
    area, group, serial = (_long(F.substring(text, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    out = feistel(area - 1 - (area > 666).cast("bigint"), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")
    return _bind(out, lambda x: F.concat_ws("-", _pad(x["l"] + 1 + (x["l"] >= 665).cast("bigint"), 3), _pad(F.floor(x["r"] / 9999) + 1, 2), _pad(x["r"] % 9999 + 1, 4)))


def _date_parts(text: Column) -> Column:
    """struct(y, m, d, style): year first, or day first where that is a date and month first otherwise."""
    parts = F.transform(F.split(text, r"[-/.]"), lambda c: c.cast("int"))

    def build(p: Column) -> Column:
        iso = text.rlike(r"^\d{4}-")
        swapped = ~iso & (p[1] > 12)
        return F.struct(
            F.when(iso, p[0]).otherwise(p[2]).alias("y"),
            F.when(iso, p[1]).when(swapped, p[0]).otherwise(p[1]).alias("m"),
            F.when(iso, p[2]).when(swapped, p[1]).otherwise(p[0]).alias("d"),
            F.when(iso, 0).when(swapped, 2).otherwise(1).alias("style"),
        )

    return _bind(parts, build)


def valid_date(text: Column) -> Column:
    def check(p: Column) -> Column:
        leap = (p["y"] % 4 == 0) & ((p["y"] % 100 != 0) | (p["y"] % 400 == 0))
        days = F.when(p["m"] == 2, F.when(leap, 29).otherwise(28)).when(p["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        return p["y"].between(1900, 2099) & p["m"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= days)

    return _bind(_date_parts(text), check)


def new_date(text: Column, key: str) -> Column:
    """Another day of 1900 to 2099 in the same notation, two digits for day and month."""

    def build(p: Column) -> Column:
        number = F.datediff(F.make_date(p["y"], p["m"], p["d"]), F.lit(FIRST_DAY).cast("date")).cast("bigint")

        def walk(now: Column, turn: Column) -> Column:  # once, and on from numbers that are no day
            out = feistel(F.floor(now / DAYS_B), now % DAYS_B, (DAYS_A, DAYS_B), key, "date")
            return F.when((turn == 0) | (now >= DAYS), _bind(out, lambda x: x["l"] * DAYS_B + x["r"])).otherwise(now)

        walked = F.aggregate(F.sequence(F.lit(0), F.lit(DAYS_A * DAYS_B - DAYS)), number, walk)
        day = _bind(walked, lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")))
        sep = F.regexp_extract(text, r"[-/.]", 0)

        def show(d: Column) -> Column:
            return F.when(p["style"] == 0, F.date_format(d, "yyyy-MM-dd")).when(
                p["style"] == 2, F.concat_ws("/", F.date_format(d, "MM"), F.date_format(d, "dd"), F.date_format(d, "yyyy"))
            ).otherwise(F.concat(F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy")))

        return _bind(day, show)

    return _bind(_date_parts(text), build)


def new_email(text: Column, key: str) -> Column:
    local, domain = F.substring_index(text, "@", 1), F.lower(F.substring_index(text, "@", -1))
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(local), domain), 256), 1, 12), F.lit("@"), domain)


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def classify(match: Column) -> Column:
    """The kind of a match of ANY, or null if it is not valid. Kinds are told apart by shape, in the order of ANY."""
    card = CARD.replace(r"\2", r"\1")
    return (
        F.when(F.contains(match, F.lit("@")), "email")
        .when(match.rlike(_whole(DATE)), F.when(valid_date(match), "date"))
        .when(match.rlike(_whole(IP)), F.when(valid_ip(match), "ip"))
        .when(match.rlike(_whole(SSN)), F.when(valid_ssn(match), "ssn"))
        .when(match.rlike(_whole(PHONE)), F.when(valid_phone(match), "phone"))
        .when(match.rlike(_whole(IBAN)), F.when(valid_iban(match), "iban"))
        .when(match.rlike(_whole(card)), F.when(valid_card(match), "card"))
    )


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", new_email(match, key))
        .when(kind == "date", new_date(match, key))
        .when(kind == "ip", new_ip(match, key))
        .when(kind == "ssn", new_ssn(match, key))
        .when(kind == "phone", new_phone(match, key))
        .when(kind == "iban", new_iban(match, key))
        .when(kind == "card", new_card(match, key))
        .otherwise(match)
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", found: str | None = "pii") -> DataFrame:
    """df with personal data in its text replaced, and if `found` is a name, a column of struct(kind, pseudonym) of
    each replaced value in order. Columns of these names are replaced, others stay."""
    if not key:
        raise ValueError("pseudonyms need a key: whoever has it can undo them")
    column = F.col(f"`{text}`")
    swaps = F.transform(
        F.transform(F.regexp_extract_all(column, F.lit(ANY), 0), lambda m: F.struct(m.alias("match"), classify(m).alias("kind"))),
        lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["match"], x["kind"], key).alias("new")),
    )
    worth, held = column.rlike("[0-9@]"), fresh(df, "_swaps")
    out = df.withColumn(held, F.when(worth, swaps))
    gaps = F.split(column, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.col(held), lambda g, s: F.array(g, F.coalesce(s["new"], F.lit(""))))), "")
    out = out.withColumn(text, F.when(F.size(held) > 0, joined).otherwise(column))
    if found:
        out = out.withColumn(found, F.coalesce(F.filter(held, lambda s: s["kind"].isNotNull()), F.array().cast("array<struct<kind:string,new:string>>")))
    return out.drop(held)

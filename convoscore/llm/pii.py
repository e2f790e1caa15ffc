"""PII pseudonyms that keep their format, in DataFrame functions only.

Values are found by one pattern, validated (Luhn, mod 97, octets, calendar, area numbers) and permuted by a keyed Feistel
network within their format: a card stays a card with a right check digit, a date a date in its notation.  The permutation
depends on the key, the kind and the length only, and not on the notation (spaces, signs, order of a date's parts, letters'
case, short forms of an address), so equal values get equal pseudonyms in every document, and two values never share one,
but for dates with the month first, whose pseudonyms may read like another date's with the day first.  E-mail addresses
and secrets get keyed digests of their form.  What does not validate stays as it is.

No shuffle, no join: every document is rewritten where it lies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates permute within ranges of left * right days, by (first day, left, right): those before 1900, those up to
#: 2099-11-23, and those up to the end of 9999.
DATE_RANGES = ((0, 745, 931), (693595, 245, 298), (766605, 1534, 1881))
DAY_ONE = "0001-01-01"

EMAIL = r"(?<![\p{L}\p{M}0-9._%+-])[\p{L}\p{M}0-9._%+-]++@(?:[\p{L}\p{M}0-9-]++\.)+[\p{L}\p{M}]{2,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,30}|(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])"
#: Four numbers that a version may be are no address.
IPV4 = r"(?<![0-9A-Za-z])(?<![0-9]\.)(?<!(?:[Vv]ersion|[Rr]elease|[Bb]uild) )[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
YMD_DATE = r"(?<![0-9./-])[0-9]{4}(?:-[0-9]{2}-[0-9]{2}|/[0-9]{1,2}/[0-9]{1,2}|\.[0-9]{1,2}\.[0-9]{1,2})(?![0-9-]|[./][0-9])"
DMY_DATE = r"(?<![0-9./])[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}(?![0-9]|[./][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-][0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\2[0-9]{4}(?![0-9])|(?<![0-9.+-])(?<![0-9] )(?:[2-9][0-9]{2} [0-9]{3} [0-9]{4}|0[1-9](?: [0-9]{2}){4})(?! ?[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})(?![0-9])"
#: How access tokens of well-known services begin.
TOKEN_HEAD = r"(?:AKIA|ASIA|AIza|eyJ|sk-(?:[a-z]+-)?|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|(?:sk|rk|pk)_(?:live|test)_)"
TOKEN = rf"(?<![0-9A-Za-z_-]){TOKEN_HEAD}[0-9A-Za-z_-]{{16,}}+(?:\.[0-9A-Za-z_-]++)*+"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, TOKEN, IBAN, IPV6, IPV4, YMD_DATE, DMY_DATE, SSN, PHONE, CARD, SECRET))
MARK = "\x01"
#: What a text must hold to be searched at all.
HINT = rf"[0-9@]|{TOKEN_HEAD}"
#: Country codes of telephone numbers of one and two digits; all others have three.
COUNTRY = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card", "secret")


def _digest(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def _number(digest: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Callable:
    """Alternating Feistel network on pairs of numbers below (left_size, right_size); returns a function that takes what
    to make of the new pair.

    Even rounds add a keyed function of the right half to the left half, odd rounds the other way round; each round can
    be undone, so the whole is a permutation."""

    def step(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        mixed = _number(_digest(key, tweak, i, F.when(even, pair["r"]).otherwise(pair["l"])))
        return F.struct(
            F.when(even, (pair["l"] + mixed % left_size) % left_size).otherwise(pair["l"]).alias("l"),
            F.when(even, pair["r"]).otherwise((pair["r"] + mixed % right_size) % right_size).alias("r"),
        )

    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return lambda then: F.aggregate(rounds, begin, step, then)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of as many digits (2 to 18)."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a
    left, right = F.substring(digits, 1, a), F.substring(digits, a + 1, b)
    size = lambda k: F.rpad(F.lit("1"), (k + 1).cast("int"), "0").cast("long")
    run = feistel(left, right, size(a), size(b), key, F.concat_ws("/", F.lit(tweak), n))
    return run(lambda p: F.concat(F.lpad(p["l"].cast("string"), a, "0"), F.lpad(p["r"].cast("string"), b, "0")))


def _digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    chars = F.split(value, "")

    def put(acc: Column, c: Column) -> Column:
        number = c.between("0", "9") & (F.length(c) == 1)
        return F.struct(F.concat(acc["s"], F.when(number, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + number.cast("int")).alias("k"))

    return F.aggregate(chars, start, put, lambda acc: acc["s"])


def _luhn_digit(body: Column) -> Column:
    """The check digit that makes body + digit pass Luhn: the rightmost digit of the body counts double."""
    n = F.length(body)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(body, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(body, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)).otherwise(F.substring(body, i, F.lit(1)).cast("int")),
    )
    return ((10 - total % 10) % 10).cast("string")


def _mod97(iban: Column) -> Column:
    """Remainder of the rearranged number: letters count from 10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban) - 4), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add)


def _iban(value: Column, key: str) -> Column:
    bare = F.upper(F.regexp_replace(value, " ", ""))
    body = F.substring(bare, F.lit(5), F.length(bare) - 4)
    digits = _digits_of(body)
    # up to 18 digits at a time; the rest of a longer number is a block of its own
    first, rest = F.substring(digits, 1, 18), F.substring(digits, 19, 18)
    new = F.concat(permute_digits(first, key, "iban"), F.when(F.length(rest) >= 2, permute_digits(rest, key, "iban2")).otherwise(rest))
    moved = _refill(body, new)
    check = F.lpad((98 - _mod97(F.concat(F.substring(bare, 1, 2), F.lit("00"), moved))).cast("string"), 2, "0")
    joined = F.concat(F.substring(bare, 1, 2), check, moved)
    spaced = F.when(F.contains(value, F.lit(" ")), F.rtrim(F.regexp_replace(joined, "(.{4})", "$1 "))).otherwise(joined)
    return F.when((F.length(digits) >= 2) & (_mod97(bare) == 1), F.when(value == F.lower(value), F.lower(spaced)).otherwise(spaced))


def _card(value: Column, key: str) -> Column:
    digits = _digits_of(value)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = permute_digits(body, key, "card")
    return F.when(F.substring(digits, -1, 1) == _luhn_digit(body), _refill(value, F.concat(new, _luhn_digit(new))))


def _phone(value: Column, key: str) -> Column:
    """The country code stays; the number behind it is the same in every notation."""
    digits = _digits_of(value)
    code = F.when(value.startswith("+"), F.regexp_extract(digits, f"^(?:{COUNTRY})", 0)).otherwise("")
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    return _refill(value, F.concat(code, permute_digits(rest, key, "phone")))


def _ssn(value: Column, key: str) -> Column:
    area = F.substring(value, 1, 3)
    valid = ~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")
    # areas 001-665 and 667-899 are 898 numbers, groups 99, serials 9999: left half area, right half the rest
    a = area.cast("long") - 1 - F.when(area > "666", 1).otherwise(0)
    b = (F.substring(value, 5, 2).cast("long") - 1) * 9999 + F.substring(value, 8, 4).cast("long") - 1
    run = feistel(a, b, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))

    def show(p: Column) -> Column:
        number = p["l"] + 1
        return F.format_string("%03d-%02d-%04d", number + F.when(number > 665, 1).otherwise(0), F.floor(p["r"] / 9999) + 1, p["r"] % 9999 + 1)

    return F.when(valid, run(show))


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    run = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    shown = run(lambda p: F.concat_ws(".", *(x.cast("string") for half in ("l", "r") for x in (F.floor(p[half] / 256), p[half] % 256))))
    return F.when(F.forall(octets, lambda x: x < 256), shown)


def _ipv6(value: Column, key: str) -> Column:
    """All eight groups of the pseudonym are written, whatever the value leaves out."""
    halves = F.split(value, "::", -1)
    groups = [F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda x: x != "") for k in (0, 1)]
    missing = 8 - F.size(groups[0]) - F.size(groups[1])
    whole = F.concat(groups[0], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), groups[1])
    digits = F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), "")
    bits = lambda x: F.conv(x, 16, -10).cast("long")

    def step(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        mixed = bits(F.substring(_digest(key, "ipv6", i, F.when(even, pair["r"]).otherwise(pair["l"])), 1, 16))
        return F.struct(F.when(even, pair["l"].bitwiseXOR(mixed)).otherwise(pair["l"]).alias("l"), F.when(even, pair["r"]).otherwise(pair["r"].bitwiseXOR(mixed)).alias("r"))

    begin = F.struct(bits(F.substring(digits, 1, 16)).alias("l"), bits(F.substring(digits, 17, 16)).alias("r"))
    shown = lambda p: F.regexp_replace(F.lower(F.concat(F.lpad(F.hex(p["l"]), 16, "0"), F.lpad(F.hex(p["r"]), 16, "0"))), "(.{4})(?=.)", "$1:")
    right = F.when(F.contains(value, F.lit("::")), missing >= 1).otherwise(missing == 0)
    return F.when(right, F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step, shown))


def _date(value: Column, key: str) -> Column:
    parts = F.split(value, r"[./-]")
    first = F.length(parts[0]) == 4  # the year

    def read(year: int, month: int, day: int) -> Column:
        return F.try_to_date(F.concat_ws("-", F.get(parts, F.lit(year)), F.lpad(F.get(parts, F.lit(month)), 2, "0"), F.lpad(F.get(parts, F.lit(day)), 2, "0")), "yyyy-MM-dd")

    # the day first, or else the month; a pseudonym with the month first may read like one with the day first
    month_first = ~first & read(2, 1, 0).isNull()
    day = F.when(first, read(0, 1, 2)).otherwise(F.coalesce(read(2, 1, 0), read(2, 0, 1)))
    n = F.datediff(day, F.lit(DAY_ONE).cast("date")).cast("long")

    def pick(k: int) -> Column:
        out = F.lit(DATE_RANGES[0][k])
        for r in DATE_RANGES[1:]:
            out = F.when(n >= r[0], F.lit(r[k])).otherwise(out)
        return out.cast("long")

    begin, left, right = (pick(k) for k in range(3))
    run = feistel(F.floor((n - begin) / right), (n - begin) % right, left, right, key, F.concat_ws("/", F.lit("date"), begin.cast("string")))
    new = run(lambda p: F.date_add(F.lit(DAY_ONE).cast("date"), (begin + p["l"] * right + p["r"]).cast("int")))
    mark = F.regexp_extract(value, "[./-]", 0)
    turned = lambda *forms: F.concat_ws("", F.date_format(new, forms[0]), mark, F.date_format(new, forms[1]), mark, F.date_format(new, forms[2]))
    shown = F.when(first, turned("yyyy", "MM", "dd")).when(month_first, turned("MM", "dd", "yyyy")).otherwise(turned("dd", "MM", "yyyy"))
    return F.when(n >= 0, shown)


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(_digest(key, "email", F.lower(value)), 1, 16), F.lit("@mail.invalid"))


def _secret(value: Column, key: str) -> Column:
    new = F.substring(_digest(key, "secret", F.lower(value)), F.lit(1), F.length(value))
    return F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _token(value: Column, key: str) -> Column:
    """The head and the signs stay; letters and digits become digits of a digest."""
    head = F.regexp_extract(value, f"^{TOKEN_HEAD}", 0)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("token"), value), 512)
    body = F.split(F.substring(value, F.length(head) + 1, F.length(value)), "")
    new = F.array_join(F.transform(body, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(digest, i % 128 + 1, F.lit(1))).otherwise(c)), "")
    return F.concat(head, F.when(value.rlike("^A[KS]IA"), F.upper(new)).otherwise(new))


def pseudonym(value: Column, key: str) -> Column:
    """STRUCT(kind, new): the pseudonym of one found value; kind is null and new the value itself if it does not validate."""
    # what parts a value from its neighbours is not in the value, so that back references count anew
    tries = [
        ("email", F.contains(value, F.lit("@")), _email),
        ("secret", value.rlike(f"^{TOKEN_HEAD}[0-9A-Za-z_-]{{16}}"), _token),
        ("ip", F.contains(value, F.lit(":")), _ipv6),
        ("iban", value.rlike("^[A-Za-z]{2}[0-9]{2}") & ~value.rlike("^[0-9a-f]{32}|^[0-9A-F]{32}"), _iban),
        ("ip", value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), _ip),
        ("date", value.rlike(r"^[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}$|^[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4}$"), _date),
        ("ssn", value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn),
        ("phone", value.rlike(r"^[+(]|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$|^[0-9]{3} [0-9]{3} [0-9]{4}$|^0[0-9]( [0-9]{2}){4}$"), _phone),
        ("card", value.rlike("^[0-9 -]{13,23}$"), _card),
        ("secret", value.rlike("^[0-9a-fA-F]{32,64}$"), _secret),
    ]
    new = kind = None
    for name, fits, make in tries:
        new = F.when(fits, make(value, key)) if new is None else new.when(fits, make(value, key))
        kind = F.when(fits, F.lit(name)) if kind is None else kind.when(fits, F.lit(name))
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_replaced and a count for each kind.

    Null texts count as empty; long ones are searched whole.  Other columns are ignored; ids may be null or repeated, and
    rows that repeat are rewritten each; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # What lies between values and the values in turn: one search puts marks around them, and the text is parted there; a
    # text that holds the mark itself is searched once for the one and once for the other.
    marked = F.split(F.regexp_replace("text", ANY, f"{MARK}$0{MARK}"), MARK, -1)
    apart = F.zip_with(F.split("text", ANY, -1), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda part, value: F.array(part, F.coalesce(value, F.lit(""))))
    pieces = F.when(~F.col("text").rlike(HINT), F.array("text")).when(F.contains("text", F.lit(MARK)), F.flatten(apart)).otherwise(marked)
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("pieces", pieces)
    named = found.select("doc_id", F.transform("pieces", lambda v, i: F.struct(v.alias("old"), F.when(i % 2 == 1, pseudonym(v, key)).alias("p"))).alias("named"))
    filled = F.array_join(F.transform("named", lambda v: F.coalesce(v["p"]["new"], v["old"])), "")

    def count(test: Callable) -> Column:
        return F.size(F.filter("named", test)).cast("long")

    def of_kind(kind: str) -> Callable:
        return lambda v: (v["p"]["kind"] == kind) & v["p"]["new"].isNotNull()

    return named.select(
        "doc_id",
        filled.alias("text"),
        count(lambda v: v["p"]["new"].isNotNull()).alias("n_replaced"),
        *(count(of_kind(k)).alias(f"n_{k}") for k in KINDS),
    )

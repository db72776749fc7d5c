"""PII [native]: format-preserving Feistel pseudonyms for validated values.

Values are found by one pattern, validated, and permuted inside their own format under a key, so an
equal value gets an equal pseudonym in every document and no two values share one:

- card: 13 to 19 digits with a valid Luhn digit; all but the last are permuted, the last is made anew
- iban: ISO 13616 with valid mod-97 digits; the account part is permuted, the check digits made anew
- ssn: AAA-GG-SSSS of the valid ranges, permuted over exactly those
- ip: four octets, permuted over all 2^32
- phone: 7 to 15 digits as written; the country code after + stays
- date: a day of the calendar, permuted over its 400 years; year-first, or day- or month-first before the year
- email: letters and digits of the part before the @ permuted within their class, the domain stays

A match of digits that is no card as a whole may hold cards: rows of groups in one of SHAPES, with the first digits
of ISSUER and a valid Luhn digit. A printed IBAN may have other words behind it. A value that fails its validation stays as it is. Separators stay. The permutation is a Feistel network
over two halves, added in the ring of each half, so it needs no cycle walking; rounds take SHA-2 of key,
kind, round and the other half.

Defined cases: a null text stays null with no values; other columns are kept by `pseudonymise` and
ignored by the query; repeated rows come back as often as they came.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, bind, table

ROUNDS = 8
KEY_CONF = "spark.patchwright.pii.key"
_session_keys: dict[str, str] = {}
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
# The forms of the seven kinds, in the order in which they are tried.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)[ -]?)?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,4})(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+",
}
#: Group lengths and first digits of a card that stands among other digits.
SHAPES = "^(?:1[3-9]|4-4-4-4(?:-[1-3])?|4-4-4-[1-3]|4-4-5|4-6-[45]|6-10|6-13|8-8|2(?:-2){6,8}|1(?:-1){12,18})$"
ISSUER = "^(?:2[2-7]|[3-6])"
ANY = "|".join(FORMS.values())
LETTERS, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def round_value(key: Column, kind: str, r: Column, other: Column) -> Column:
    """A non-negative number under 2^60."""
    return number(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), other.cast("string")), 256), 1, 15))


def permute_pair(left: Column, right: Column, m: int, n: int, key: Column, kind: str) -> Column:
    """struct(l, r): a keyed permutation of Z_m x Z_n."""
    def step(s: Column, r: Column) -> Column:
        low = F.pmod(s["l"] + round_value(key, kind, r, s["r"]), F.lit(m).cast("bigint"))
        return bind(low, lambda x: F.struct(x.alias("l"), F.pmod(s["r"] + round_value(key, kind, -r, x), F.lit(n).cast("bigint")).alias("r")))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step)


def permute_characters(text: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the strings of one shape: digits, a-z and A-Z move in their class, the rest stays."""
    def moved(half: Column, other: Column, r: Column) -> Column:
        stream = lambda i: F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), i.cast("string"), F.array_join(other, "")), 512)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(half) / 32).cast("int")), stream)

        def one(c: Column, by: Column) -> Column:
            def within(alphabet: str) -> Column:
                return F.substr(F.lit(alphabet), (F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))

            return F.when(c.between("0", "9"), within(DIGITS)).when(c.between("a", "z"), within(LETTERS)).when(c.between("A", "Z"), within(CAPITALS)).otherwise(c)

        return bind(blocks, lambda b: F.transform(half, lambda c, i: one(c, number(F.substr(F.get(b, F.floor(i / 32).cast("int")), (i % 32) * 4 + 1, F.lit(4))))))

    def step(s: Column, r: Column) -> Column:
        return bind(moved(s["a"], s["b"], r), lambda a: F.struct(a.alias("a"), moved(s["b"], a, -r).alias("b")))

    def whole(c: Column) -> Column:
        cut = F.floor(F.size(c) / 2).cast("int")
        start = F.struct(F.slice(c, F.lit(1), cut).alias("a"), F.slice(c, cut + 1, F.size(c)).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))

    return bind(F.split(text, ""), whole)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def fill(form: Column, digits: Column) -> Column:
    """The digits put in the places of the form's digits, one after another."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        own = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(own, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """Luhn sum mod 10, counting from the last digit."""
    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(s["odd"], 2).otherwise(1)
        return F.struct((s["n"] + d - F.when(d > 9, 9).otherwise(0)).alias("n"), (~s["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("odd"))
    return F.aggregate(F.reverse(F.split(digits, "")), start, add, lambda s: s["n"] % 10)


def mod97(text: Column) -> Column:
    """ISO 7064 remainder of digits and capitals (A is 10)."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: F.when(c.between("0", "9"), (n * 10 + c.cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))


def card(v: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        body = permute_characters(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        return bind(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))

    return bind(digits_of(v), lambda d: F.when(F.length(d).between(13, 19) & (luhn(d) == 0) & (F.length(F.regexp_replace(d, F.substr(d, F.lit(1), F.lit(1)), F.lit(""))) > 0), fill(v, new(d))))


def iban(v: Column, key: Column) -> Column:
    def whole(c: Column) -> Column:
        ok = F.length(c).between(15, 34) & (mod97(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))) == 1)
        land = F.substr(c, F.lit(1), F.lit(2))
        new = permute_characters(F.substr(c, F.lit(5)), key, "iban")
        made = bind(new, lambda b: F.concat(land, F.lpad((98 - mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(ok, bind(made, lambda m: F.when(F.instr(v, " ") > 0, F.btrim(F.regexp_replace(m, "(.{4})", "$1 "))).otherwise(m)))

    return bind(F.replace(v, F.lit(" "), F.lit("")), whole)


def ip(v: Column, key: Column) -> Column:
    def new(o: Column) -> Column:
        moved = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        part = lambda x: [F.floor(x / 256), x % 256]
        dotted = bind(moved, lambda m: F.concat_ws(".", *(p.cast("bigint").cast("string") for p in part(m["l"]) + part(m["r"]))))
        return F.when(F.forall(o, lambda x: x <= 255), dotted)

    return bind(F.transform(F.split(v, r"\."), lambda x: x.cast("int")), new)


def date(v: Column, key: Column) -> Column:
    """Days since 1970 within a 400-year era of 146097 = 189 * 773 days."""
    first = F.substr(v, F.lit(5), F.lit(1)).rlike("[-/.]")
    parts = F.split(v, "[-/.]")

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.unix_date(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd"))

    def moved(days: Column, form) -> Column:
        off = F.unix_date(F.to_date(F.lit("2000-03-01")))
        place = F.pmod(days - off, F.lit(146097))
        pair = permute_pair(F.floor(place / 773), place % 773, 189, 773, key, "date")
        new = bind(pair, lambda p: F.date_from_unix_date((days - place + p["l"] * 773 + p["r"]).cast("int")))
        return bind(new, form)

    def build(p: Column) -> Column:
        sep = F.substr(v, F.when(first, 5).otherwise(3), F.lit(1))
        pick = lambda f: lambda x: F.replace(F.date_format(x, f), F.lit("-"), sep)
        ymd, dmy, mdy = day(p[0], p[1], p[2]), day(p[2], p[1], p[0]), day(p[2], p[0], p[1])
        return F.when(first, bind(ymd, lambda x: moved(x, pick("yyyy-MM-dd")))).otherwise(F.coalesce(bind(dmy, lambda x: moved(x, pick("dd-MM-yyyy"))), bind(mdy, lambda x: moved(x, pick("MM-dd-yyyy")))))

    return bind(parts, build)


def ssn(v: Column, key: Column) -> Column:
    def new(p: Column) -> Column:
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)  # 1..899 without 666 as 0..897
        moved = permute_pair(area, (p[1] - 1) * 9999 + p[2] - 1, 898, 99 * 9999, key, "ssn")
        back = lambda m: F.format_string("%03d-%02d-%04d", m["l"] + F.when(m["l"] >= 665, 2).otherwise(1), F.floor(m["r"] / 9999) + 1, m["r"] % 9999 + 1)
        ok = p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        return F.when(ok, bind(moved, back))

    return bind(F.transform(F.split(v, "-"), lambda x: x.cast("int")), new)


def phone(v: Column, key: Column) -> Column:
    code = F.regexp_extract(v, r"^\+[0-9]{1,3}(?=[^0-9])", 0)
    code = F.when((code == "") & F.startswith(v, F.lit("+")), F.substr(v, F.lit(1), F.lit(2))).otherwise(code)
    rest = bind(code, lambda c: F.substr(v, F.length(c) + 1))

    def new(r: Column) -> Column:
        moved = bind(permute_characters(digits_of(r), key, "phone"), lambda d: fill(r, d))
        return F.when(F.length(digits_of(v)).between(7, 15), F.concat(F.substr(v, F.lit(1), F.length(v) - F.length(r)), moved))

    return bind(rest, new)


def email(v: Column, key: Column) -> Column:
    return F.concat(permute_characters(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


MAKERS = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(value: Column, key: Column) -> Column:
    """struct(kind, value) of one match: the first kind whose form and validation fit; kind null where none does."""
    def attempt(kind: str) -> Column:
        named = lambda x: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), x.alias("value")))
        return F.when(value.rlike("^(?:" + FORMS[kind] + ")$"), bind(MAKERS[kind](value, key), named))

    tries = [attempt(kind) for kind in KINDS]
    return F.coalesce(*tries, F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value")))


PARTS = "array<struct<kind:string,value:string>>"


def steps(key: Column):
    """Functions over one match, each applied to what the one before it made; apart, as the analyzer bounds the depth of one expression.

    A match is taken as a whole if it is valid. Else a printed IBAN is its longest row of groups that is valid, and
    of digits (those behind the IBAN too) the rows of groups in a card's SHAPES that are valid are replaced, from the left."""
    def whole(v: Column) -> Column:
        return F.struct(v.alias("old"), pseudonym(v, key).alias("p"))

    def heads(x: Column) -> Column:
        groups = F.split(x["old"], " ")
        each = F.transform(F.sequence(F.size(groups) - 1, F.lit(4), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        printed = x["p"]["kind"].isNull() & x["old"].rlike("^[A-Z]{2}[0-9]{2}( [A-Z0-9]+){4,}$")
        return F.struct(x["old"].alias("old"), x["p"].alias("p"), F.when(printed, each).alias("heads"))

    def tried(x: Column) -> Column:
        made = F.transform(x["heads"], lambda h: F.struct(h.alias("old"), iban(h, key).alias("new")))
        return F.struct(x["old"].alias("old"), x["p"].alias("p"), made.alias("made"))

    def headed(x: Column) -> Column:
        return F.struct(x["old"].alias("old"), x["p"].alias("p"), F.get(F.filter(x["made"], lambda y: y["new"].isNotNull()), 0).alias("head"))

    def grouped(x: Column) -> Column:
        left = F.substr(x["old"], F.coalesce(F.length(x["head"]["old"]), F.lit(0)) + 1)
        some = x["p"]["kind"].isNull() & x["old"].rlike("^[A-Z0-9 -]{14,}$")
        v = F.when(some, left)
        groups = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
        return F.struct(x["old"].alias("old"), x["p"].alias("p"), x["head"].alias("head"), v.alias("v"), groups.alias("g"), F.split(v, "[0-9]+", -1).alias("gaps"))

    def rows(x: Column) -> Column:
        def row(i: Column, n: Column) -> Column:
            part = F.slice(x["g"], i, n)
            shape = F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), "-")
            return F.struct(i.alias("i"), n.alias("n"), F.when(shape.rlike(SHAPES), F.array_join(part, "")).alias("d"))

        size = F.size(x["g"])
        each = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), size - i + 1)), lambda n: row(i, n))))
        return F.struct(*(x[c].alias(c) for c in ("old", "p", "head", "v", "g", "gaps")), F.when(size > 0, F.filter(each, lambda y: y["d"].rlike(ISSUER))).alias("rows"))

    def valid(x: Column) -> Column:
        made = F.transform(x["rows"], lambda y: F.struct(y["i"].alias("i"), y["n"].alias("n"), card(y["d"], key).alias("new")))
        return F.struct(*(x[c].alias(c) for c in ("old", "p", "head", "v", "g", "gaps")), made.alias("rows"))

    def chosen(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<i:int,n:int,new:string>>").alias("hits"))
        step = lambda a, y: F.when(y["new"].isNotNull() & (y["i"] > a["last"]), F.struct((y["i"] + y["n"] - 1).alias("last"), F.concat(a["hits"], F.array(y)).alias("hits"))).otherwise(a)
        return F.struct(*(x[c].alias(c) for c in ("old", "p", "head", "v", "g", "gaps")), F.aggregate(x["rows"], start, step, lambda a: a["hits"]).alias("hits"))

    def dressed(x: Column) -> Column:
        """Each hit with the text between its groups."""
        def old(y: Column) -> Column:
            return F.array_join(F.transform(F.slice(x["g"], y["i"], y["n"]), lambda g, k: F.concat(F.when(k > 0, F.get(x["gaps"], y["i"] - 1 + k)).otherwise(""), g)), "")

        hits = F.transform(x["hits"], lambda y: F.struct(y["i"].alias("i"), y["n"].alias("n"), fill(old(y), y["new"]).alias("new")))
        return F.struct(*(x[c].alias(c) for c in ("old", "p", "head", "v", "g", "gaps")), hits.alias("hits"))

    def built(x: Column) -> Column:
        def between(a: Column, z: Column) -> Column:
            """The groups a to z - 1 with the gap before each."""
            return F.array_join(F.transform(F.slice(x["g"], a, z - a), lambda g, k: F.concat(F.get(x["gaps"], a + k - 1), g)), "")

        first = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
        step = lambda s, y: F.struct(F.concat(s["text"], between(s["at"], y["i"]), F.get(x["gaps"], y["i"] - 1), y["new"]).alias("text"), (y["i"] + y["n"]).alias("at"))
        end = F.size(x["g"])
        rest = F.aggregate(x["hits"], first, step, lambda s: F.concat(s["text"], between(s["at"], end + 1), F.get(x["gaps"], end)))
        text = F.concat(F.coalesce(x["head"]["new"], F.lit("")), F.coalesce(rest, x["v"]))
        named = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        none = F.array().cast(PARTS)
        own = F.when(x["p"]["kind"].isNotNull(), F.array(x["p"]).cast(PARTS)).otherwise(none)
        head = F.when(x["head"].isNotNull(), F.array(named("iban", x["head"]["new"])).cast(PARTS)).otherwise(none)
        inner = F.coalesce(F.transform(x["hits"], lambda y: named("card", y["new"])).cast(PARTS), none)
        return F.struct(F.coalesce(F.when(x["v"].isNotNull(), text), x["p"]["value"]).alias("value"), F.concat(own, head, inner).alias("parts"))

    return (whole, heads, tried, headed, grouped, rows, valid, chosen, dressed, built)


def pseudonymise(docs: DataFrame, key: str, column: str = "pii") -> DataFrame:
    """docs with `text` pseudonymised, and `column`: array of struct(kind, value) of the new values in order (null for a null text).

    The key reaches the executors as a broadcast row, so neither plan nor event log shows it."""
    secret, found, made = apart(docs, "key", "found", "made")
    text, kept = F.col("text"), [F.col(f"`{c}`") for c in docs.columns]
    some = F.coalesce(text.rlike("[0-9][0-9.]|[0-9][ -][0-9]|@"), F.lit(False))  # any form has one of these
    empty = F.array().cast("array<struct<value:string,parts:array<struct<kind:string,value:string>>>>")
    out = docs.crossJoin(F.broadcast(docs.sparkSession.createDataFrame([(key,)], f"{secret} string")))
    out = out.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    for step in steps(F.col(secret)):
        out = out.withColumn(found, F.transform(found, step))
    out = out.withColumn(found, F.when(some, F.col(found)).when(text.isNotNull(), empty))
    joined = bind(F.split(text, ANY, -1), lambda g: F.array_join(F.transform(g, lambda x, i: F.concat(x, F.coalesce(F.get(F.col(found), i)["value"], F.lit("")))), ""))
    out = out.withColumn(made, F.when(F.size(found) > 0, joined).otherwise(text))
    new = [F.col(made).alias("text") if c == "text" else k for c, k in zip(docs.columns, kept, strict=True)]
    return out.select(*new, F.flatten(F.transform(found, lambda x: x["parts"])).alias(column))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs in their columns, whatever their names, with `text` pseudonymised."""
    (found,) = apart(docs, "pii")
    return pseudonymise(docs, key, found).drop(found)


def key_of(spark: SparkSession) -> str:
    """The key in KEY_CONF; unset, a random one of this application: pseudonyms then are linked within it only."""
    key = spark.conf.get(KEY_CONF, None) or spark.sparkContext.getConf().get(KEY_CONF)
    return key or _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def count_of(kind: str) -> Column:
    return F.coalesce(F.size(F.filter("pii", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, key_of(spark))
    return out.select("doc_id", "text", *(count_of(k) for k in KINDS))

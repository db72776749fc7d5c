import datetime
import hashlib
import re

from pyspark.sql import functions as F

from patchwright.llm import pii

VALUES = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "378282246310005"],
    "iban": ["DE89370400440532013000"],
    "ssn": ["123-45-6789", "899-99-9999", "001-01-0001"],
    "ip": ["192.168.1.10", "0.0.0.0", "255.255.255.255"],
    "phone": ["+1 (555) 555-5657", "555-123-4567", "+49 30 1234567"],
    "date": ["2024-02-29", "31/12/1999", "12/31/1999", "2024/05/06"],
    "email": ["joe.Smith+1@mail.example.com"],
}
INVALID = ["4111111111111112", "DE89370400440532013001", "666-45-6789", "300.1.1.1", "2023-02-29", "1.2.3", "0000000000000000"]


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r for r in pii.pseudonymise(df, key).collect()}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_values_keep_their_format(spark):
    flat = [(k, v) for k, vs in VALUES.items() for v in vs]
    out = run(spark, [f"see {v}, yes" for _, v in flat])
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    for i, (kind, v) in enumerate(flat):
        (p,) = out[i]["pii"]
        assert p["kind"] == kind and p["value"] != v and out[i]["text"] == f"see {p['value']}, yes"
        if kind != "ip":
            assert shape(p["value"]) == shape(v)
        if kind == "card":
            assert luhn(p["value"]) % 10 == 0
        if kind == "iban":
            t = p["value"][4:] + p["value"][:4]
            assert int("".join(str(int(c, 36)) for c in t)) % 97 == 1
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in p["value"].split("."))
    assert out[0]["pii"][0]["value"].replace(" ", "") == out[1]["pii"][0]["value"], "one number, two formats, one pseudonym"


def test_invalid_values_stay(spark):
    out = run(spark, INVALID)
    assert [out[i]["text"] for i in range(len(INVALID))] == INVALID


def test_equal_values_stay_linked_and_others_apart(spark):
    out = run(spark, ["call +1 (555) 555-5657 or 10.0.0.1", "10.0.0.1 and +1 (555) 555-5657", "+1 (555) 555-5658 190.137.223.204"])
    a, b, c = ({x["kind"]: x["value"] for x in out[k]["pii"]} for k in range(3))
    assert a == b and a["phone"] != c["phone"] and a["ip"] != c["ip"]
    assert run(spark, ["10.0.0.1"], "other")[0]["text"] != run(spark, ["10.0.0.1"])[0]["text"]


def test_permutations_are_one_to_one(spark):
    days = spark.range(3000).select(F.date_format(F.date_from_unix_date(F.col("id").cast("int") * 40), "yyyy-MM-dd").alias("v"))
    new = days.select(pii.date(F.col("v"), F.lit("k")).alias("n"))
    assert new.distinct().count() == 3000 and new.where("n IS NULL").count() == 0
    area = spark.range(2000).select(F.format_string("%03d-%02d-%04d", F.when(F.col("id") % 899 + 1 == 666, 1).otherwise(F.col("id") % 899 + 1), F.col("id") % 99 + 1, F.col("id") + 1).alias("v"))
    moved = area.select(pii.ssn(F.col("v"), F.lit("k")).alias("n"))
    assert moved.distinct().count() == 2000 and moved.where("n IS NULL OR n LIKE '666%' OR n LIKE '000%' OR n LIKE '9%' OR n LIKE '%-00-%' OR n LIKE '%-0000'").count() == 0
    digits = spark.range(1000).select(pii.permute_characters(F.format_string("%03d", "id"), F.lit("k"), "phone").alias("n"))
    assert digits.distinct().count() == 1000


def test_values_among_other_digits(spark):
    card, iban = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"
    texts = [f"card {card} 12/25", "4111111111111111 123", "2 4111111111111111 x", f"12 34 {card} 99 88", f"{card} 5500 0000 0000 0004", f"to {iban}, x", "BE68 5390 0754 7034 EUR 5", "BE68 5390 0754 7034 4111 1111 1111 1111", "call 555 123 4567 now", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"]
    kinds = ["card", "card", "card", "card", "card card", "iban", "iban", "iban card", "phone", "card"]
    out = run(spark, [*texts, card, "BE68539007547034", "1990 1991 1992 1993 1994 1995"])
    for i, (t, k) in enumerate(zip(texts, kinds, strict=True)):
        assert " ".join(x["kind"] for x in out[i]["pii"]) == k, t
        assert len(out[i]["text"]) == len(t) and all(x["value"] in out[i]["text"] for x in out[i]["pii"])
        assert not any(v in out[i]["text"].replace(" ", "").replace("-", "") for v in ("4111111111111111", "WEST12345698765432", "539007547034", "5551234567", "5500000000000004"))
    new = out[len(texts)]["text"]
    assert out[0]["text"] == f"card {new} 12/25" and out[3]["text"] == f"12 34 {new} 99 88"
    assert out[1]["text"] == new.replace(" ", "") + " 123"
    assert out[6]["pii"][0]["value"].replace(" ", "") == out[len(texts) + 1]["text"]
    assert out[len(texts) + 2]["text"] == "1990 1991 1992 1993 1994 1995"


# a plain version, by the rules of the module's docstring


def shake(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def plain_pair(x, y, m, n, key, kind):
    for r in range(1, 5):
        x = (x + int(shake(key, kind, r, y)[:15], 16)) % m
        y = (y + int(shake(key, kind, -r, x)[:15], 16)) % n
    return x, y


def plain_characters(s, key, kind):
    def moved(half, other, r):
        out = []
        for i, c in enumerate(half):
            stream = hashlib.sha512("|".join(map(str, (key, kind, r, i // 32, "".join(other)))).encode()).hexdigest()
            by = int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)
            home = next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), None)
            out.append(home[(home.index(c) + by) % len(home)] if home else c)
        return out

    a, b = list(s[: len(s) // 2]), list(s[len(s) // 2 :])
    for r in range(1, 5):
        a = moved(a, b, r)
        b = moved(b, a, -r)
    return "".join(a + b)


def refill(form, digits):
    rest = iter(digits)
    return re.sub("[0-9]", lambda _: next(rest), form)


def plain_card(v, key):
    d = re.sub("[^0-9]", "", v)
    if 13 <= len(d) <= 19 and luhn(d) % 10 == 0 and len(set(d)) > 1:
        body = plain_characters(d[:-1], key, "card")
        return refill(v, body + str(-luhn(body + "0") % 10))
    return None


def plain_iban(v, key):
    c = v.replace(" ", "")
    number = lambda t: int("".join(str(int(x, 36)) for x in t))
    if not 15 <= len(c) <= 34 or number(c[4:] + c[:4]) % 97 != 1:
        return None
    b = plain_characters(c[4:], key, "iban")
    out = f"{c[:2]}{98 - number(b + c[:2] + '00') % 97:02d}{b}"
    return " ".join(out[i : i + 4] for i in range(0, len(out), 4)) if " " in v else out


def plain_ip(v, key):
    o = [int(x) for x in v.split(".")]
    if max(o) > 255:
        return None
    x, y = plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def plain_date(v, key):
    sep = re.search("[-/.]", v)[0]
    p = [int(x) for x in v.split(sep)]
    for order, form in (((0, 1, 2), "{0:04d}s{1:02d}s{2:02d}"),) if len(v.split(sep)[0]) == 4 else (((2, 1, 0), "{2:02d}s{1:02d}s{0:04d}"), ((2, 0, 1), "{1:02d}s{2:02d}s{0:04d}")):
        try:
            day = datetime.date(*(p[k] for k in order))
        except ValueError:
            continue
        days, start = day.toordinal(), datetime.date(2000, 3, 1).toordinal()
        place = (days - start) % 146097
        x, y = plain_pair(place // 773, place % 773, 189, 773, key, "date")
        new = datetime.date.fromordinal(days - place + x * 773 + y)
        return form.format(new.year, new.month, new.day).replace("s", sep)
    return None


def plain_ssn(v, key):
    a, g, n = (int(x) for x in v.split("-"))
    if not (1 <= a <= 899 and a != 666 and g and n):
        return None
    x, y = plain_pair(a - (2 if a > 666 else 1), (g - 1) * 9999 + n - 1, 898, 99 * 9999, key, "ssn")
    return f"{x + (2 if x >= 665 else 1):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"


def plain_phone(v, key):
    if not 7 <= len(re.sub("[^0-9]", "", v)) <= 15:
        return None
    m = re.match(r"\+[0-9]{1,3}(?=[^0-9])", v)
    code = m[0] if m else v[:2] if v.startswith("+") else ""
    rest = v[len(code) :]
    return code + refill(rest, plain_characters(re.sub("[^0-9]", "", rest), key, "phone"))


def plain_email(v, key):
    name, _, domain = v.partition("@")
    return f"{plain_characters(name, key, 'email')}@{domain}"


def plain_match(v, key):
    for kind in pii.KINDS:
        if re.fullmatch(pii.FORMS[kind], v, re.ASCII) and (new := globals()[f"plain_{kind}"](v, key)):
            return new
    out = ""
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}( [A-Z0-9]+){4,}", v):
        groups = v.split(" ")
        for n in range(len(groups) - 1, 3, -1):
            if new := plain_iban(" ".join(groups[:n]), key):
                out, v = new, v[len(" ".join(groups[:n])) :]
                break
    if not out and not re.fullmatch("[A-Z0-9 -]{14,}", v):
        return v
    at = [m.span() for m in re.finditer("[0-9]+", v)]
    i = last = 0
    while i < len(at):
        for n in range(1, min(19, len(at) - i) + 1):
            part = at[i : i + n]
            d = "".join(v[a:b] for a, b in part)
            if re.search(pii.SHAPES, "-".join(str(b - a) for a, b in part)) and re.search(pii.ISSUER, d) and (new := plain_card(d, key)):
                out += v[last : part[0][0]] + refill(v[part[0][0] : part[-1][1]], new)
                last, i = part[-1][1], i + n - 1
                break
        i += 1
    return out + v[last:]


def test_by_brute_force(spark, small, documents):
    extra = ["see 12/31/1999 or 31.12.1999 or 2024-02-29", "x 4111 1111 1111 1111 12/25 y", "to GB82 WEST 1234 5698 7654 32, x", "BE68 5390 0754 7034 4111 1111 1111 1111", "a@b.co 10.0.0.1 300.1.1.1 +49 30 1234567 (555) 123-4567", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"]
    docs = {**documents, **{-1 - k: t for k, t in enumerate(extra)}}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replaced(df, "brute").collect()}
    form = re.compile(pii.ANY, re.ASCII)
    want = {i: form.sub(lambda m: plain_match(m[0], "brute"), t) for i, t in docs.items()}
    assert got == want and sum(got[i] != docs[i] for i in docs) > 10


def test_the_key_is_not_in_the_plan(spark):
    df = spark.createDataFrame([(1, "10.0.0.1")], "doc_id bigint, text string")
    plan = pii.pseudonymise(df, "verysecretkey")._jdf.queryExecution().toString()
    assert "verysecretkey" not in plan
    assert pii.key_of(spark) == pii.key_of(spark) and len(pii.key_of(spark)) == 64


def test_edge_cases(spark, odd):
    odd = odd.selectExpr("*", "5 AS kind", "6 AS value", "7 AS _Found")
    out = pii.replaced(odd, "k")
    assert out.columns == odd.columns
    assert sorted(map(repr, (r["text"] for r in out.collect()))) == sorted(map(repr, (r["text"] for r in odd.collect())))
    assert pii.replaced(odd.limit(0), "k").count() == 0

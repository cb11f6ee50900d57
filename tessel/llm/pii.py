"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

Entities are found by patterns; names behind a title, and then wherever a word of such
a name occurs again in the same text. Each distinct normalised entity of the whole
table gets a surrogate derived from a secret key: digits for digits, letters for
letters, a valid check digit for a valid one, a name of the same gender and
script for a name. Surrogates that coincide with each other or with an entity
that occurs are drawn anew until none does, so different entities stay different
and one entity is the same everywhere, in whatever format it is written. The map
of a text's entities is joined back by the text's hash, so copies share it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import let, materialize, unused

_TITLES = {
    "m": "Mr Sir Lord Herr Señor Monsieur господин Κύριος κύριος",
    "f": "Mrs Ms Miss Lady Madam Frau Señora Madame Mme госпожа Κυρία κυρία",
    "x": "Dr Prof",
}
_TITLE = "|".join(sorted((t for listed in _TITLES.values() for t in listed.split()), key=len, reverse=True))
_EDGE = r"[\p{L}\p{M}\p{N}_]"
_WORD = rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}]{{1,30}}+|\p{{Lo}}[\p{{Lo}}\p{{M}}]{{0,30}}+)(?!{_EDGE})"
#: A title and one or two words of a name.
NAME = rf"(?<!{_EDGE})(?:{_TITLE})\.? {_WORD}(?: {_WORD})?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?=(?:[A-Z ]*\d){6})(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4}))(?!\w)",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![\w:])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "phone": r"(?<![\w.])\+[1-9](?:[ .\-/]?\(?\d\)?){6,14}+(?!\w)|(?<![\w.\-])\d{3}\.\d{3}\.\d{4}(?![\w\-]|\.\d)|(?<![\w.\-]|\d )\d{3} \d{3} \d{4}(?![\w\-]| \d)|(?<![\w.])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?!\w)|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.\-])\d{3}-\d{3}-\d{4}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
}
#: Draws for one entity. Formats have 10**9 values and more, names grow with each draw.
ATTEMPTS = 40
OTHER = "|".join(PATTERNS.values())
ANY = f"{OTHER}|{NAME}"
#: Every match of ANY holds one of these, which are far cheaper to look for: strings (of titles that hold others the shorter), patterns.
_STRINGS = [t for t in _TITLE.split("|") if not any(u != t and u in t for u in _TITLE.split("|"))] + ["AKIA", "sk-"]
_SIGNS = ("[0-9@]", "[a-f]{32}|gh[pousr]_|:[A-Fa-f]{0,4}:")
#: Country calling codes: those of one and two digits, all others have three.
_CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

# Name parts: our own choice. A given name is a stem, as many middles as draws need, and an ending of its gender.
STEMS = {
    "latin": "Al Ber Cor Dan El Fab Ger Han Is Jul Kar Leon Mar Nor Or Pat Ros Sim Tor Val Wil Adr Bran Clem Dor Em Flor Gust Hel Ign",
    "cyrillic": "Ал Бор Вик Гал Дан Ел Жан Зин Ив Кир Лев Мар Ник Ол Пав Ром Сем Тим Фед Юл",
    "greek": "Αλ Βασ Γερ Δημ Ελ Ζην Ηλ Θεο Ιω Καλ Λεων Μαρ Νικ Ορ Παν Ροδ Σταυ Τιμ Φιλ Χρη",
}
MIDDLES = {"latin": "an er il on ar in et al or iv em ol", "cyrillic": "ан ер ил он ар ин ет ал ор ив ем ол", "greek": "αν ερ ιλ ον αρ ιν ετ αλ ορ ιβ εμ ολ"}
ENDINGS = {
    ("m", "latin"): "o us ian as ert ald ic en", ("f", "latin"): "a ia ina elle ette ica anne ora",
    ("m", "cyrillic"): "ий ан ей ор им ид", ("f", "cyrillic"): "а ия ина ья ена ика",
    ("m", "greek"): "ος ης ας ων ιος ινος", ("f", "greek"): "α η ια ινα ουλα ικη",
}
SYLLABLES = {
    "latin": "ba de fi go ku la me ni po ru sa te vi wo zu ran", "cyrillic": "ба де фи го ку ла ме ни по ру са те ви во зу ран",
    "greek": "βα δε φι γο κου λα με νι πο ρου σα τε βι ζου ρα θω", "han": "安 白 陈 德 方 国 海 嘉 康 林 明 宁 平 秋 瑞 思",
    "kana": "あ い う か き く さ た な は ま み や ら り わ", "hangul": "가 나 다 라 마 바 사 아 자 하 민 서 지 준 은 수",
    "arabic": "با دا فا كا لا ما نا را سا تا وا زا جا حا شا صا", "hebrew": "בא דא הא לא מא נא סא פא קא רא שא תא גא זא חא טא",
    "devanagari": "बा दा फा गा का ला मा नि पा रा सा ता वी जा हा शा",
}
#: Java's names of the scripts; letters of any other script count as latin.
_SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "han": "IsHan", "kana": "IsHiragana", "hangul": "IsHangul", "arabic": "IsArabic", "hebrew": "IsHebrew", "devanagari": "IsDevanagari"}
_LETTERS = {"Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _kind(raw: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(raw.rlike(rf"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _pick(words: str, seed: Column) -> Column:
    listed = words.split()
    return F.get(F.array(*map(F.lit, listed)), F.pmod(F.xxhash64(seed), F.lit(len(listed))).cast("int"))


def _spoken(script: str, seed: Column, numbers: Column) -> Column:
    """A syllable for each of `numbers`."""
    return F.array_join(F.transform(numbers, lambda i: _pick(SYLLABLES[script], F.concat(seed, i.cast("string")))), "")


def _alike(text: Column, seed: Column) -> Column:
    """Each digit, capital and small letter replaced by one of its kind and, if Latin, Cyrillic or Greek, of its script; all else stays."""

    def other(c: Column, draw) -> Column:
        small = draw(_LETTERS["Latin"])
        for script in ("Cyrillic", "Greek"):
            small = F.when(c.rlike(rf"\p{{Is{script}}}"), draw(_LETTERS[script])).otherwise(small)
        return F.when(c.rlike(r"\p{Lu}"), F.upper(small)).otherwise(small)

    def one(c: Column, i: Column) -> Column:
        at = F.xxhash64(seed, i)
        draw = lambda s: F.substr(F.lit(s), (F.pmod(at, F.lit(len(s))) + 1).cast("int"), F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), draw("0123456789")).when(c.rlike("[a-z]"), draw("abcdefghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-Z]"), draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{N}"), draw("0123456789"))
            .when(c.rlike(r"\p{L}"), other(c, draw)).otherwise(c)
        )

    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _hex(text: Column, seed: Column) -> Column:
    draw = lambda c, i: F.when(c == ":", c).otherwise(at(i))
    at = lambda i: F.substr(F.lit("0123456789abcdef"), (F.pmod(F.xxhash64(seed, i), F.lit(16)) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.split(text, ""), draw), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check, 0 modulo 10 for a valid number."""
    back = F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int"))
    odd = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(back, odd), F.lit(0), lambda a, x: a + x)


def _card(norm: Column, seed: Column) -> Column:
    """Like the number, and valid if and only if it is."""
    drawn = _alike(norm, seed)
    head = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10))
    other = F.pmod(check + 1 + F.pmod(F.xxhash64(seed), F.lit(9)).cast("int"), F.lit(10))
    return F.concat(head, F.when(_luhn(norm) % 10 == 0, check).otherwise(other).cast("string"))


def _mod97(text: Column) -> Column:
    """The number that digits and letters (A is 10, Z is 35) write, modulo 97."""

    def step(a: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(v < 10, 10).otherwise(100) + v) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(norm: Column, seed: Column) -> Column:
    """Of the same country, and with valid check digits if and only if the account number has them."""
    country = F.substr(norm, F.lit(1), F.lit(2))
    valid = _mod97(F.concat(F.substr(norm, F.lit(5)), F.substr(norm, F.lit(1), F.lit(4)))) == 1

    def whole(account: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))
        other = F.pmod(check - 1 + F.pmod(F.xxhash64(seed), F.lit(96)).cast("int"), F.lit(97)) + 2
        return F.concat(country, F.lpad(F.when(valid, check).otherwise(other).cast("string"), 2, "0"), account)

    return let(_alike(F.substr(norm, F.lit(5)), seed), whole)


def _surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    seeds = F.struct(
        F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256).alias("own"),
        F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index(norm, "@", -1)), 256).alias("domain"),
    )
    return let(seeds, lambda s: _drawn(kind, norm, attempt, s["own"], s["domain"]))


def _drawn(kind: Column, norm: Column, attempt: Column, seed: Column, domain: Column) -> Column:
    octet = lambda i: F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(256)).cast("string")
    code = F.regexp_extract(norm, r"^(\+\d{1,3})_", 1)
    # Two draws of the same length may coincide; later ones are longer.
    longer = F.slice(F.sequence(F.lit(0), attempt), 1, attempt)
    middle = lambda script: F.array_join(F.transform(longer, lambda i: _pick(MIDDLES[script], F.concat(seed, F.lit("m"), i.cast("string")))), "")
    name = F.lit("")
    for script in STEMS:
        of = lambda listed, mark, script=script: _pick(listed, F.concat(seed, F.lit(mark)))
        female = F.when(kind.startswith("given_x"), F.pmod(F.xxhash64(seed, F.lit("g")), F.lit(2)) == 0).otherwise(kind.startswith("given_f"))
        ending = F.when(female, of(ENDINGS["f", script], "e")).otherwise(of(ENDINGS["m", script], "e"))
        either = F.concat(of(STEMS[script], "s"), of(MIDDLES[script] + " " + MIDDLES[script], "n"), middle(script), ending)
        name = F.when(kind.startswith("given") & kind.endswith(script), either).otherwise(name)
    for script in SYLLABLES:
        dense = script not in STEMS
        made = _spoken(script, seed, F.sequence(F.lit(0), attempt + (1 if dense else 4)))
        here = kind.endswith(f"_{script}") if dense else kind == f"surname_{script}"
        name = F.when(here, F.initcap(made)).otherwise(name)
    return (
        F.when(kind == "email", F.concat(_alike(F.substring_index(norm, "@", 1), seed), F.lit("@"), _alike(F.lit("aaaaaa"), domain), F.lit(".example.org")))
        .when(kind == "secret", F.when(norm.rlike("^[0-9a-f]+$"), _hex(norm, seed)).otherwise(
            F.concat(F.regexp_extract(norm, "^(AKIA|gh._|sk-)", 1), _alike(F.regexp_replace(norm, "^(AKIA|gh._|sk-)", ""), seed))))
        .when(kind == "iban", _iban(norm, seed))
        .when(kind == "ipv6", _hex(norm, seed)).when(kind == "ip", F.concat_ws(".", *map(octet, range(4))))
        .when(kind == "phone", F.concat(code, F.when(code != "", F.lit("_")).otherwise(F.lit("")), _alike(F.regexp_replace(norm, r"^\+\d{1,3}_", ""), seed)))
        .when(kind == "card", _card(norm, seed))
        .when(kind == "ssn", _alike(norm, seed))
        .otherwise(name)
    )


def _script(name: Column) -> Column:
    out = F.lit("latin")
    for script, java in _SCRIPTS.items():
        out = F.when(name.rlike(rf"\p{{{java}}}"), F.lit(script)).otherwise(out)
    return out


def _parts(raw: Column, kind: Column) -> Column:
    """The entities in a match: array of (kind, norm). A name has up to two, else there is one."""
    digits = F.regexp_replace(raw, r"\D", "")
    # By the digits alone, so that a number has one norm with separators and without.
    code = F.regexp_extract(digits, _CALLING, 0)
    phone = F.when(raw.startswith("+"), F.concat(F.lit("+"), code, F.lit("_"), F.substr(digits, F.length(code) + 1))).otherwise(digits)
    bare = F.split(F.regexp_replace(raw, rf"^(?:{_TITLE})\.? ", ""), " ")
    title = F.regexp_extract(raw, rf"^({_TITLE})", 1)
    gender = F.when(title.isin(_TITLES["f"].split()), F.lit("f")).when(title.isin(_TITLES["x"].split()), F.lit("x")).otherwise(F.lit("m"))
    one = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    last = let(F.element_at(bare, -1), lambda n: one(F.concat(F.lit("surname_"), _script(n)), n))
    first = let(F.get(bare, F.lit(0)), lambda n: one(F.concat(F.lit("given_"), gender, F.lit("_"), _script(n)), n))
    norm = F.when(kind.isin("email", "ipv6"), F.lower(raw)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).otherwise(raw)
    return F.when(kind == "name", F.when(F.size(bare) > 1, F.array(first, last)).otherwise(F.array(last))).otherwise(F.array(one(kind, norm)))


def _laid_out(raw: Column, kind: Column, new: Column) -> Column:
    """Surrogate `new` in the format of the match."""
    fill = lambda gaps, signs: F.array_join(F.zip_with(gaps, signs, lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    digits = F.split(F.regexp_replace(new, r"\D", ""), "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), fill(F.split(raw, "[0-9]", -1), digits))
        .when(kind == "iban", fill(F.split(raw, "[A-Z0-9]", -1), F.split(new, "")))
        .when(kind.isin("email", "ipv6") & (raw == F.upper(raw)), F.upper(new)).otherwise(new)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for distinct `entities` (kind, norm), free of collisions.

    A surrogate that another entity of its kind got, or that occurs as an entity
    of its kind, is drawn anew with the next attempt; of several that coincide
    the one of least norm keeps it. Each round handles the losers of the last.
    """
    norms = entities.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("occurs"))
    todo, done = entities, None
    attempt = 0
    while True:
        drawn = todo.withColumn("surrogate", _surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("owner"))
        taken = norms if done is None else norms.union(done.select("kind", "surrogate", F.lit(True)))
        judged = materialize(
            drawn.join(first, ["kind", "surrogate"]).join(taken.distinct(), ["kind", "surrogate"], "left")
            .withColumn("free", F.col("occurs").isNull() & (F.col("owner") == F.col("norm"))).select("kind", "norm", "surrogate", "free"), "surrogates"
        )
        good = judged.where("free").select("kind", "norm", "surrogate")
        done = good if done is None else done.union(good)
        todo = judged.where("NOT free").select("kind", "norm")
        if todo.isEmpty():
            return done
        attempt += 1
        if attempt > ATTEMPTS:
            raise ValueError("some kind of entity has more members than its format has free values")


def _suspect(text: Column) -> Column:
    """Whether a text holds an entity; the patterns are tried only where something hints at one."""
    hints = [*(text.rlike(sign) for sign in _SIGNS), *(text.contains(s) for s in _STRINGS)]
    return F.coalesce(reduce(Column.__or__, hints) & text.rlike(ANY), F.lit(False))


def _replaced(hit: DataFrame, key: str, count: str) -> DataFrame:
    """The rows of `hit` (a written table; each row holds entities) with new texts and their number in column `count`."""
    if not key:
        raise ValueError("surrogates need a secret key")
    at, entries = unused(hit.columns, "__pii_key"), unused(hit.columns, "__pii_map")
    keyed = hit.withColumn(at, F.xxhash64("text"))
    matches = F.concat(F.regexp_extract_all("text", F.lit(OTHER), F.lit(0)), F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))
    raw = materialize(keyed.select(F.col(at).alias("at"), F.explode(F.array_distinct(matches)).alias("raw")).distinct(), "matches")
    forms = materialize(
        raw.select("raw").distinct().withColumn("form", _kind(F.col("raw"))).select("raw", "form", F.explode(_parts(F.col("raw"), F.col("form"))).alias("part"))
        .select("raw", "form", "part.kind", "part.norm"), "forms"
    )
    made = surrogates(forms.select("kind", "norm").distinct(), key)
    # What is sought in a text and what replaces it: a match, or each word of a name, of which a text has one reading.
    is_name = F.col("form") == "name"
    rank = F.when(F.col("kind").startswith("given_x"), 2).when(F.col("kind").startswith("surname"), 1).otherwise(0)
    new = forms.join(made, ["kind", "norm"]).select(
        "raw", F.when(is_name, F.col("norm")).otherwise(F.col("raw")).alias("old"),
        F.struct(rank.alias("rank"), F.when(is_name, F.col("surrogate")).otherwise(_laid_out(F.col("raw"), F.col("form"), F.col("surrogate"))).alias("new"), is_name.alias("name")).alias("to"),
    )
    read = raw.join(new, "raw").groupBy("at", "old").agg(F.min("to").alias("to"))
    # One map for each distinct text: as many entries as it has entities.
    per_text = read.groupBy("at").agg(F.collect_list(F.struct("old", "to")).alias("all"))
    names = F.transform(F.filter("all", lambda e: e["to"]["name"]), lambda e: e["old"])
    maps = per_text.select(
        F.col("at").alias(at),
        F.struct(
            F.map_from_entries(F.transform("all", lambda e: F.struct(e["old"].alias("key"), e["to"]["new"].alias("value")))).alias("to"),
            F.when(F.size(names) > 0, F.concat(F.lit(f"{OTHER}|(?<!{_EDGE})(?:"), F.array_join(names, "|"), F.lit(f")(?!{_EDGE})"))).otherwise(F.lit(OTHER)).alias("pattern"),
        ).alias(entries),
    )
    maps = materialize(maps, "maps")
    pattern, to = F.col(f"{entries}.pattern"), F.col(f"{entries}.to")
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.split("text", pattern, -1)
    text = F.array_join(F.zip_with(gaps, found, lambda g, e: F.concat(F.coalesce(g, F.lit("")), F.coalesce(F.element_at(to, e), e, F.lit("")))), "")
    return keyed.join(maps, at).withColumns({count: F.size(found).cast("long"), "text": text}).drop(at, entries)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, text) of the rows of `docs` (doc_id, text) that hold personal data.

    Rows without any, null and empty texts among them, are not returned.
    Repeated rows are returned as often as they occur. Other columns are not read. Each word of a name counts as an entity.
    """
    # The patterns cost more than all else: rows that hold something are written once, and no later step tries the others.
    hit = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).where(_suspect(F.col("text"))), "hits")
    return _replaced(hit, key, "n_entities").select("doc_id", "n_entities", "text")


def anonymize(docs: DataFrame, key: str) -> DataFrame:
    """All rows of `docs` with personal data in `text` replaced; n_chars, if there, follows the text.

    Null and empty texts, and rows without personal data, stay as they are; repeated rows stay, each with
    the same new text. All columns stay, in whatever names. An empty table gives an empty one; a missing key raises.
    """
    flag = unused(docs.columns, "__pii")
    judged = materialize(docs.withColumn(flag, _suspect(F.col("text"))), "judged")
    count = unused(judged.columns, "__pii_count")
    changed = _replaced(judged.where(flag), key, count)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns).union(judged.where(~F.col(flag)).select(docs.columns))

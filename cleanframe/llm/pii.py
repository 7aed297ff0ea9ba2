"""Personal data: detected entities get keyed surrogates of the same type, in DataFrame functions only.

Detected: e-mail addresses, IBANs, social security numbers, payment cards, IPv4 addresses, phone numbers, access keys,
`password=...` fields, and names after a title; in a text with a titled name, its words are found again without one.
A given name has one entity, whose gender is that of any titled mention. An entity is its kind and canonical value (digits without layout,
lower-case address, ...). Its surrogate is drawn from SHA-512 of the secret key, kind, value and attempt, so that every
mention in every document gets the same one, and is written into the layout of each mention: digits stay digits, letters
keep script and case, cards and IBANs keep a right (or wrong) check digit, names keep gender and script.

Collision checks: a surrogate that two entities of a kind draw, or that is itself a detected value of that kind, goes to
the smallest value only or to none; the others draw again. So distinct entities stay distinct and nothing maps to a real one.

Late attempts draw longer surrogates, so that also values with few others of their layout find a free one; IPv4 addresses
keep their size, and all of 60 draws fail with a chance of s^60 where a share s of all addresses is detected. Letters without
a plain alphabet become letters of their script. An address or field value without any letter or digit is no entity.

Defined results: NULL and empty texts stay. Repeated rows are changed alike. Documents are told apart by id and text, so
ids may repeat or be NULL. All other columns are returned as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cleanframe.llm.common import packed_rows, row_keys, salted_join, written

# Titles by gender, and alphabets in which letters are exchanged.
MALE = "Mr|Herr|Señor|Monsieur|господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Madame|Mme|госпожа|г-жа"
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
HEX = ["0123456789", "abcdef"]
#: Letters and digits of no alphabet above become one of their script; the first class that fits wins, and the last two fit
#: what remains.
SCRIPTS = [
    (r"\p{IsHan}", "天地山水火木金土日月人口手心石田力工大小中上下左右春夏秋冬東西"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねの"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノ"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하거너더러머버서어저처"),
    (r"[\p{L}&&\p{IsArabic}]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"[\p{L}&&\p{IsHebrew}]", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"[\p{L}&&\p{IsDevanagari}]", "अआइईउऊएकखगघचछजझटठडढतथदधनपफबभमयरलवशसह"),
    (r"[\p{L}&&\p{IsThai}]", "กขคงจชซญณดตถทธนบปผพฟภมยรลวศสหอ"),
    (r"[\p{L}&&\p{IsGeorgian}]", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"),
    (r"[\p{Lu}&&\p{IsArmenian}]", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՒՓՔ"),
    (r"[\p{L}&&\p{IsArmenian}]", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփք"),
    (r"[\p{Lu}&&\p{IsCyrillic}]", ALPHABETS[4]),
    (r"[\p{L}&&\p{IsCyrillic}]", ALPHABETS[3]),
    (r"[\p{Lu}&&\p{IsGreek}]", ALPHABETS[6]),
    (r"[\p{L}&&\p{IsGreek}]", ALPHABETS[5]),
    (r"[\u0660-\u0669]", "٠١٢٣٤٥٦٧٨٩"),
    (r"[\u06F0-\u06F9]", "۰۱۲۳۴۵۶۷۸۹"),
    (r"[\u0966-\u096F]", "०१२३४५६७८९"),
    (r"\p{N}", ALPHABETS[0]),
    (r"[\p{Lu}\p{Lt}]", ALPHABETS[2]),
    (r"\p{L}", ALPHABETS[1]),
]
#: Syllables of surrogate names, by script; the last syllable is by gender.
SYLLABLES = {"latin": "ba de fi go ka lu mi no pa re si to va wen jo hal".split(), "cyrillic": "ба де фи го ка лу ми но па ре си то ва вен жо хал".split()}
ENDINGS = {
    "latin": {"m": "rik ton bert mund".split(), "f": "lina rietta nessa bella".split(), "u": "ley ran sen mont".split()},
    "cyrillic": {"m": "рик тон берт мунд".split(), "f": "лина рита несса белла".split(), "u": "лей ран сен мон".split()},
}

TITLE = rf"(?:{MALE}|{FEMALE}|Dr|Prof)"
#: Two letters or more, with inner capitals, hyphens and apostrophes; not the 's of a possessive.
NAME = r"(?=\p{Lu}(?:[\p{L}\p{M}]|['’\-]\p{L}))\p{Lu}[\p{L}\p{M}]*+(?:(?:['’](?!s(?![\p{L}\p{M}]))|-)[\p{L}\p{M}]++){0,3}+"
PARTICLE = r"(?:von|van|zu|de|der|den|del|della|di|da|dos|du|la|le|el|al|bin|ibn|y)"
BETWEEN = rf"(?:(?:{PARTICLE}|\p{{Lu}}\.) ){{0,3}}"
#: A word that may be a name again.
UNTITLED = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]){NAME}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FIELD = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)\s{0,3}(?:=\s{0,3}|:\s{0,3}(?=[\"']?[^\s\"']{0,4000}\d))"
#: A field's value: up to the closing quote of its line, or up to white space or a quote; a letter or digit is in its first 4,000 characters.
SPACE = r"\s\p{Z}\p{Cc}"
VALUE = (
    r"(?:\"(?=[^\"\p{Cc}\p{Zl}\p{Zp}\p{L}\p{N}]{0,4000}[\p{L}\p{N}])[^\"\p{Cc}\p{Zl}\p{Zp}]{6,}+(?=\")"
    r"|'(?=[^'\p{Cc}\p{Zl}\p{Zp}\p{L}\p{N}]{0,4000}[\p{L}\p{N}])[^'\p{Cc}\p{Zl}\p{Zp}]{6,}+(?=')"
    rf"|[\"']?(?=[^{SPACE}\"'\p{{L}}\p{{N}}]{{0,4000}}[\p{{L}}\p{{N}}])[^{SPACE}\"']{{6,}}+)"
)
#: kind: (pattern, what must not stand before, what must not stand after). The first kind that fits a place wins.
PATTERNS = {
    "field": (FIELD + VALUE, r"[\p{L}\p{N}_]", r"$^"),
    "key": (r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+|(?=[a-f]*+\d)[0-9a-f]{32,}+", r"[\p{L}\p{N}_]", r"[\p{L}\p{N}_]"),
    "email": (r"(?=[._%+\-]*+(?:@\-*+)?[\p{L}\p{N}])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++", r"[\p{L}\p{N}._%+\-]", r"$^"),
    "iban": (r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[\p{L}\p{N}]", r"[\p{L}\p{N}]"),
    "ssn": (r"\d{3}-\d{2}-\d{4}", r"[\p{N}\-]", r"\p{N}|-\p{N}"),
    "card": (r"\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}", r"[\p{L}\p{N}+]", r"\p{N}"),
    "ipv4": (rf"(?:{OCTET}\.){{3}}{OCTET}", r"[\p{N}.]", r"\p{N}|\.\p{N}"),
    "phone": (
        r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}",
        r"[\p{L}\p{N}+]",
        r"\p{N}",
    ),
    "person": (rf"{TITLE}\.? {BETWEEN}{NAME}(?: (?!{TITLE}\.? ){BETWEEN}{NAME}){{0,3}}", r"[\p{L}\p{N}]", r"\p{L}"),
}
ANY = "|".join(f"(?<!{before})(?:{pattern})(?!{after})" for pattern, before, after in PATTERNS.values())
#: A text without any of these holds no entity.
HINT = rf"[0-9@=]|AKIA|ASIA|gh[pousr]_|sk-|{TITLE}\.? (?:{PARTICLE} |\p{{Lu}})"
KEYS = ["k1", "k2"]
ROUNDS = 60


def mentions(text: str) -> Column:
    """All mentions in a whole text, in order; an empty array for NULL."""
    return F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _kind(raw: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, (pattern, _, _) in reversed({**PATTERNS, "field": (FIELD + ".+", "", "")}.items()):
        found = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def _plain(raw: Column) -> Column:
    """The letters and digits of a mention."""
    return F.regexp_replace(raw, r"[^\p{L}\p{N}]", "")


def _words(raw: Column) -> Column:
    """The words of a name after its title."""
    return F.split(F.regexp_replace(raw, r"^\S+ ", ""), " ")


def _cased(surrogate: Column, word: Column) -> Column:
    """A name's surrogate, in capitals if the name is."""
    return F.when((word == F.upper(word)) & ~word.rlike(r"^\p{Lu}\.$"), F.upper(surrogate)).otherwise(surrogate)


def _parts(raw: Column, kind: Column) -> Column:
    """The entities of a mention: (kind, value); a name has one for each of its words, with no kind for particles."""
    gender = F.when(raw.rlike(rf"^(?:{MALE})(?!\p{{L}})"), "m").when(raw.rlike(f"^(?:{FEMALE})"), "f").otherwise("u")
    last = F.size(_words(raw)) - 1
    named = lambda w, i: F.when(~w.rlike(f"^{PARTICLE}$"), F.when(i == last, "family_u").otherwise(F.concat(F.lit("given_"), gender)))
    names = F.transform(_words(raw), lambda w, i: F.struct(named(w, i).alias("kind"), F.initcap(w).alias("value")))
    one = lambda value: F.array(F.struct(kind.alias("kind"), value.alias("value")))
    return (
        F.when(kind == "person", names)
        .when(kind == "email", one(F.lower(raw)))
        .when(kind == "ipv4", one(raw))
        .when(kind == "key", one(raw))
        .when(kind == "field", one(_field(raw, 2)))
        .otherwise(one(_plain(raw)))
    )


def _field(raw: Column, group: int) -> Column:
    """Of a field: 1 what stands before the value, 2 the value, 3 punctuation that may end a sentence and stays."""
    return F.regexp_extract(raw, rf"^([\p{{L}}_\-]+\s{{0,3}}[=:]\s{{0,3}}[\"']?)(.+?)([.,;:!?)\]}}>]*+)$", group)


def _chars(value: Column) -> Column:
    return F.array_remove(F.split(value, ""), "")


def _byte(stream: Column, i: Column | int) -> Column:
    """The i-th byte of a hash in hexadecimal; the hash of it and a block's number goes on after each 64 bytes."""
    if isinstance(i, int):
        return F.conv(F.substr(stream, F.lit(i * 2 + 1), F.lit(2)), 16, 10).cast("int")
    block = F.floor(i / 64).cast("string")
    own = F.when(i < 64, stream).otherwise(F.sha2(F.concat(stream, F.lit("|"), block), 512))
    return F.conv(F.substr(own, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, *parts: Column) -> Column:
    """HMAC-like: the key stands around the length-marked parts."""
    marked = [x for p in parts for x in (F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))]
    return F.sha2(F.concat(F.lit(key), F.lit("|"), *marked, F.lit("|"), F.lit(key)), 512)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _exchanged(value: Column, stream: Column, alphabets: list[str], keep: int = 0) -> Column:
    """Each character after the first `keep` becomes another one of its alphabet. With all alphabets, every other letter or
    digit becomes another one of its script; what is neither stays."""

    def one(ch: Column, i: Column) -> Column:
        letters = F.lit("")
        for script, own in reversed(SCRIPTS if alphabets is ALPHABETS else []):
            letters = F.when(ch.rlike(script), own).otherwise(letters)
        for own in alphabets:
            letters = F.when(F.position(ch, F.lit(own)) > 0, own).otherwise(letters)

        def moved(own: Column) -> Column:
            at, shift, n = F.position(ch, own), _byte(stream, i), F.length(own)
            place = F.when(at > 0, (at + shift % (n - 1)) % n).otherwise(shift % n) + 1
            return F.when((n == 0) | (i < keep), ch).otherwise(F.substr(own, place, F.lit(1)))

        return _bound(letters, moved)

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a digit string whose last digit is the check digit."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.reverse(_chars(digits)), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10


def _card(value: Column, stream: Column, more: Column) -> Column:
    body = F.concat(F.substr(_exchanged(value, stream, ALPHABETS[:1], 1), F.lit(1), F.length(value) - 1), more)
    off = (_luhn(value) - _luhn(F.concat(body, F.lit("0"))) + 20) % 10
    return F.concat(body, off.cast("string"))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN's letters and digits read as a number."""
    value = lambda ch: F.ascii(ch) - F.when(ch <= "9", 48).otherwise(55)
    return F.aggregate(_chars(text), F.lit(0), lambda a, ch: (a * F.when(ch <= "9", 10).otherwise(100) + value(ch)) % 97)


def _iban(value: Column, stream: Column, more: Column) -> Column:
    country, rest = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(5))
    body = F.concat(_exchanged(rest, stream, ALPHABETS[:3]), more)
    right = 98 - _mod97(F.concat(body, country, F.lit("00")))
    was_right = _mod97(F.concat(rest, F.substr(value, F.lit(1), F.lit(4)))) == 1
    check = F.when(was_right, right).otherwise((right + 1 + _byte(stream, 63) % 90) % 97)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _more(stream: Column, attempt: int) -> Column:
    """What late attempts add to a surrogate, so that values with few of their layout never run out."""
    extra = attempt // 4
    return F.substr(stream, F.lit(129 - extra), F.lit(extra))


def _email(value: Column, stream: Column, key: str, more: Column) -> Column:
    """Local part by the whole address, domain by the domain alone: one domain keeps one surrogate."""
    at = F.position(F.lit("@"), value)
    domain = F.substr(value, at + 1)
    top = F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    name = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    local = _exchanged(F.substr(value, F.lit(1), at - 1), stream, ALPHABETS)
    return F.concat(local, more, F.lit("@"), _exchanged(name, _stream(key, F.lit("domain"), domain), ALPHABETS), top)


def _ipv4(stream: Column) -> Column:
    return F.concat_ws(".", (1 + _byte(stream, 0) % 223).cast("string"), *[_byte(stream, i).cast("string") for i in (1, 2, 3)])


def _name(value: Column, kind: Column, stream: Column, attempt: int) -> Column:
    """A made-up name of the value's script and the kind's gender; longer with more attempts."""
    gender = F.substr(kind, F.lit(-1))

    def built(script: str) -> Column:
        pick = lambda options, i: F.get(F.array(*map(F.lit, options)), _byte(stream, i) % len(options))
        ending = F.when(gender == "m", pick(ENDINGS[script]["m"], 9)).when(gender == "f", pick(ENDINGS[script]["f"], 9)).otherwise(pick(ENDINGS[script]["u"], 9))
        return F.initcap(F.concat(*[pick(SYLLABLES[script], i) for i in range(3 + attempt // 4)], ending))

    return F.when(value.rlike(r"\p{IsCyrillic}"), built("cyrillic")).otherwise(built("latin"))


def _surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    return _bound(_stream(key, kind, value, F.lit(attempt)), lambda stream: _drawn(kind, value, stream, key, attempt))


def _drawn(kind: Column, value: Column, stream: Column, key: str, attempt: int) -> Column:
    more = _more(stream, attempt)
    digits = F.translate(more, "abcdef", "012345")
    hexadecimal = value.rlike("^[0-9a-f]+$")
    prefix = r"^(?:AKIA|ASIA|gh[pousr]_|sk-)"
    secret = F.concat(F.regexp_extract(value, f"({prefix})?", 0), _exchanged(F.regexp_replace(value, prefix, ""), stream, ALPHABETS))
    return (
        F.when(kind.startswith("given_") | kind.startswith("family_"), _name(value, kind, stream, attempt))
        .when(kind == "email", _email(value, stream, key, more))
        .when(kind == "ipv4", _ipv4(stream))
        .when(kind == "card", _card(value, stream, digits))
        .when(kind == "iban", _iban(value, stream, digits))
        .when(kind.isin("key", "field") & hexadecimal, F.concat(_exchanged(value, stream, HEX), more))
        .when(kind == "key", F.concat(secret, more))
        .when(kind == "field", F.concat(_exchanged(value, stream, ALPHABETS), more))
        .when(kind == "phone", F.concat(_exchanged(value, stream, ALPHABETS[:1], 1), digits))
        .otherwise(F.concat(_exchanged(value, stream, ALPHABETS[:1]), digits))
    )


def _laid_out(raw: Column, plain: Column) -> Column:
    """The characters of `plain` in place of the letters and digits of a mention; what is left over stands at the end."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))

    def put(acc: Column, ch: Column) -> Column:
        slot = ch.rlike(r"^[\p{L}\p{N}]$")
        own = F.when(slot, F.substr(plain, acc["at"], F.lit(1))).otherwise(ch)
        return F.struct((acc["at"] + slot.cast("int")).alias("at"), F.concat(acc["text"], own).alias("text"))

    return F.aggregate(_chars(raw), start, put, lambda acc: F.concat(acc["text"], F.substr(plain, acc["at"])))


def _renamed(gap: Column, names: Column) -> Column:
    """(text, n) of the text between two mentions: its words that are among names (value, kind, surrogate), or whose
    parts between hyphens are, get the surrogates; n words do."""

    def known(word: Column) -> Column:
        return _cased(F.get(F.filter(names, lambda x: x["value"] == F.initcap(word)), F.lit(0))["surrogate"], word)

    def new(word: Column) -> Column:
        parts = F.transform(F.split(word, "-"), lambda part: F.coalesce(known(part), part))
        return F.coalesce(known(word), F.when(F.contains(word, F.lit("-")), F.array_join(parts, "-")).otherwise(word))

    def put(changed: Column) -> Column:
        pieces = F.transform(F.split(gap, UNTITLED, -1), lambda piece, i: F.concat(piece, F.coalesce(F.get(changed, i)["new"], F.lit(""))))
        return F.struct(F.array_join(pieces, "").alias("text"), F.size(F.filter(changed, lambda x: x["old"] != x["new"])).alias("n"))

    found = F.regexp_extract_all(gap, F.lit(UNTITLED), F.lit(0))
    return _bound(F.transform(found, lambda word: F.struct(word.alias("old"), new(word).alias("new"))), put)


def with_known_gender(parts: DataFrame) -> DataFrame:
    """Rows with a kind and a value, where a given name has one kind: that of its titled mentions, `given_u` without any
    that tells or with both."""
    given = parts.filter(F.col("kind").startswith("given_"))
    told = F.when(F.col("kind") != "given_u", F.col("kind"))
    known = given.groupBy("value").agg(F.min(told).alias("low"), F.max(told).alias("high"))
    known = known.select("value", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("given_u").alias("kind"))
    one = salted_join(given.drop("kind"), known, "value").select(parts.columns)
    return parts.filter(~F.col("kind").startswith("given_")).unionByName(one)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct entities (kind, value); no two of a kind are equal, none is a value of its kind."""
    entities = written(entities.distinct(), "entities")
    done = None
    left = entities
    for attempt in range(ROUNDS):
        drawn = left.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), key, attempt))
        taken = entities.select("kind", F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        done = written(won if done is None else done.unionByName(won), "surrogates")
        left = written(entities.join(done, ["kind", "value"], "left_anti"), "entities-left")
        if left.isEmpty():
            return done
    raise ValueError(f"{left.count()} entities found no free surrogate in {ROUNDS} attempts")


class Surrogates:
    """Mentions of a table's texts and what replaces them."""

    def __init__(self, docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text"):
        self.docs, self.id_column, self.text = docs, id_column, text
        found = docs.select(*row_keys(id_column, text), mentions(text).alias("mentions")).filter(F.size("mentions") > 0)
        self.found = written(found.dropDuplicates(KEYS), "mentions")
        raws = self.found.select(F.explode("mentions").alias("raw")).distinct().withColumn("kind", _kind(F.col("raw")))
        raws = written(raws.select("raw", "kind", _parts(F.col("raw"), F.col("kind")).alias("parts")), "raw-mentions")
        flat = raws.select("raw", F.col("kind").alias("as"), F.posexplode("parts").alias("pos", "part")).select("raw", "as", "pos", "part.kind", "part.value")
        flat = written(with_known_gender(flat.filter(F.col("kind").isNotNull())), "mention-parts")
        self.entities = surrogates(flat.select("kind", "value"), key)
        drawn = flat.join(self.entities, ["kind", "value"]).groupBy("raw", "as")
        drawn = drawn.agg(F.sort_array(F.collect_list(F.struct("pos", "value", "kind", "surrogate"))).alias("new"))
        raw, kind, first = F.col("raw"), F.col("as"), F.col("new")[0]["surrogate"]
        person = F.transform(_words(raw), lambda w, i: F.coalesce(_cased(F.get(F.filter("new", lambda x: x["pos"] == i), F.lit(0))["surrogate"], w), w))
        names = F.transform(F.filter("new", lambda x: ~x["value"].endswith(".")), lambda x: F.struct(x["value"], x["kind"], x["surrogate"]))
        cased = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(first)).otherwise(first)
        replacement = (
            F.when(kind == "person", F.concat(F.regexp_extract(raw, r"^\S+ ", 0), F.array_join(person, " ")))
            .when(kind == "email", cased)
            .when(kind.isin("ipv4", "key"), first)
            .when(kind == "field", F.concat(_field(raw, 1), first, _field(raw, 3)))
            .otherwise(_laid_out(raw, first))
        )
        self.replacements = written(drawn.select("raw", kind.alias("kind"), replacement.alias("replacement"), F.when(kind == "person", names).alias("names")), "replacements")

    def replaced(self) -> DataFrame:
        """docs with the text after replacement; n_entities counts mentions, in a column of that name."""
        single = self.found.select(*KEYS, F.posexplode("mentions").alias("pos", "raw"))
        single = written(single, "single-mentions")
        joined = salted_join(single, self.replacements.select("raw", "replacement", "names"), "raw", 20_000)
        lists = joined.groupBy(*KEYS).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "replacement"))), lambda x: x["replacement"]).alias("_new"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("names")))).alias("_names"),
        )
        columns = [c for c in self.docs.columns if c != "n_entities"]
        k1, k2 = row_keys(self.id_column, self.text)
        keyed = self.docs.select(*columns, k1, k2)
        hinted = F.coalesce(F.col(self.text).rlike(HINT), F.lit(False))
        changed = keyed.filter(hinted).join(lists, KEYS, "left")
        plain = lambda gap: F.struct(gap.alias("text"), F.lit(0).alias("n"))
        gaps = F.split(F.col(self.text), ANY, -1)
        gaps = F.when(F.size("_names") > 0, F.transform(gaps, lambda gap: _renamed(gap, F.col("_names")))).otherwise(F.transform(gaps, plain))
        own, after = [c for c in changed.columns if c not in KEYS], F.struct(F.col("_new").alias("new"), gaps.alias("gaps")).alias("_after")
        changed = changed.select(*own, F.when(F.col("_new").isNotNull(), after).alias("_after"))
        pieces = F.transform("_after.gaps", lambda gap, i: F.concat(gap["text"], F.coalesce(F.get("_after.new", i), F.lit(""))))
        text = F.when(F.col("_after").isNull(), F.col(self.text)).otherwise(F.array_join(pieces, ""))
        untitled = F.aggregate("_after.gaps", F.lit(0), lambda n, gap: n + gap["n"])
        count = F.coalesce(F.size("_after.new") + untitled, F.lit(0)).cast("long")
        as_before = [F.col(c) for c in columns]
        with_new = [text.alias(c) if c == self.text else F.col(c) for c in columns]
        return changed.select(*with_new, count.alias("n_entities")).unionByName(keyed.filter(~hinted).select(*as_before, F.lit(0).cast("long").alias("n_entities")))


def replace(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of docs, with surrogates in the texts, and the column n_entities."""
    own, unpacked = packed_rows(docs.drop("n_entities") if "n_entities" in docs.columns else docs, id=id_column, text=text)
    return Surrogates(own, key, "id", "text").replaced().select(*unpacked(text="text"), "n_entities")

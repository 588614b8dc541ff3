"""Surrogates for personal data, in DataFrame operations only.

Entities are found by patterns: mail addresses, internet addresses, card, account
and social numbers, phone numbers, secrets (keys and tokens) and names after a
title.  Each distinct entity gets one keyed replacement of the same type:

* digits become digits, letters become letters of the same script and case, and
  separators stay, so the format stays; card numbers (issuer, length, grouping and
  check digit fit, or a card word stands before them) keep their issuer digit and
  whether their check digit holds; internet addresses stay in range; mail
  addresses move below a reserved domain of the same ending where there is one;
* names take given names of the gender that the title tells and family names of
  the same script; given and family names are mapped separately, so "Ms Ana Gil"
  and "Ms Gil" still agree; words of such a name are replaced alike where the same
  text has them without a title.

A replacement depends on the key and the entity's canonical form (case, blanks
and separators aside), so mentions of one entity agree in all documents.  The
check: no two entities of a type share a replacement, and no replacement is an
entity that occurs in the data.  Entities that fail are drawn again, with a
counter, until none does.

Defined results: a null text stays null, texts without entities are unchanged;
repeated rows are treated alike; an empty table gives an empty table; input
columns that clash with the outputs (in any case) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgrid.llm.common import text_key, unused, without
from termgrid.sources.scratch import materialize

# Titles by gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "госпожа", "г-жа")
MALE_TITLES = ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н")
OTHER_TITLES = ("Dr", "Prof")
# Replacement names by script and gender.
GIVEN = {
    ("latin", "f"): "Ada Bea Clara Dora Edith Flora Greta Hanna Ines Julia Klara Lena Mara Nora Olga Paula Rosa Sara Tessa Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Max Nils Oskar Paul Rolf Simon Tom Viktor".split(),
    ("latin", "n"): "Alex Andrea Billie Chris Dominique Eli Jamie Kim Lou Maxime Nikita Robin Sam Toni Val Yael Jo Sascha Rene Mika".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья Тамара Ульяна Юлия Яна".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Марк Никита Олег Павел Роман Семён Тимур Фёдор Юрий Яков Артём".split(),
    ("cyrillic", "n"): "Саша Женя Валя Никита Слава Шура Паша Миша Тоня Юра Лёля Ася Вася Гера Даня Жора Ира Катя Лёня Рая".split(),
}
# Parts of replacement family names by script; two or more make a name.
FAMILY_PARTS = {
    "latin": "bar bel ber bor bran cal cor dal del dor fal fen gar gol hal har hol kal kel kor lan lin lor mal mar mel mon nor or pal per ral ren ros sal sel sor tal ter tor val var vel vor wen wil zal zan".split(),
    "cyrillic": "бар бел бор вал вен вор гар гол дал дор жар зал зор кал кел кор лан лин лор мал мар мел нор пал пер рал рос сал сел сор тал тер тор фал хол чер шан ян".split(),
}
# Letters of each script whose characters have replacements.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)

_TITLES = "|".join(t.replace("-", r"\-") for t in (*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES))
# Loops over groups are possessive or bounded: others recurse once per round, and a long word would end the JVM's stack.
_NAME = r"\p{Lu}(?=\p{L}|['’]\p{L}{2})\p{L}*+(?:['’]\p{L}{2}\p{L}*+)*+(?:-\p{Lu}\p{L}++)?"
# Words in lower case inside a name, which stay.
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "das", "do", "dos", "du", "la", "le", "ten", "ter", "zu", "zum", "bin", "al", "el")
_GAPS = r"[\s\u00A0]+"  # what separates the words of a name
_TITLED = (
    r"(?:" + _TITLES + r")\.?(?:[ \t\u00A0]{1,3}|[ \t]?\r?\n[ \t]{0,3})" + r"(?:(?:" + "|".join(PARTICLES) + r")[ \t\u00A0]{1,2}){0,3}"
    + _NAME + r"(?:[ \t\u00A0]{1,2}(?:(?:" + "|".join(PARTICLES) + r")[ \t\u00A0]{1,2}){0,3}" + _NAME + r")*+"
)
# First four digits of 16-digit cards; American Express and Diners have 15 and 14 digits in groups of their own.
_ISSUERS = (
    r"4\d{3}|5[1-5]\d{2}|2(?:22[1-9]|2[3-9]\d|[3-6]\d{2}|7[01]\d|720)|6(?:011|4[4-9]\d|5\d{2})|35(?:2[89]|[3-8]\d)|62\d{2}|220[0-4]"
    r"|50[1-3]\d|5[6-8]\d{2}|6304|67\d{2}"
)
_CARD_SHAPES = "|".join(
    rf"(?:{_ISSUERS})(?:{sep}\d{{4}}){{3}}|(?:4\d{{3}}|62\d{{2}})(?:{sep}\d{{4}}){{3}}{sep}\d{{3}}"
    rf"|3[47]\d{{2}}{sep}\d{{6}}{sep}\d{{5}}|3(?:0[0-5]|[689]\d)\d{sep}\d{{6}}{sep}\d{{4}}" for sep in ("", " ", r"\-")
) + r"|4\d{12}|62\d{2} \d{13}"
_LONG_NUMBER = r"\d(?:[ \-]?\d){12,18}"
# Words that make a number beside them a card or a phone number, whatever its form.
_CARD_WORD = (
    r"(?<=(?<!\p{L})(?iu:card|visa|mastercard|amex|carte|tarjeta|kreditkarte|karte|карта|карты)(?i: number| no| nr| num|)(?i: is|)[.:#]{0,2}[ \t]{0,2})"
    + _LONG_NUMBER + r"(?!\d|\-\d)"
)
_PHONE_WORD = (
    r"(?<=(?<!\p{L})(?iu:telephone|telefon|téléphone|teléfono|phone|tel|mobile|cell|handy|fax|call|dial|тел)(?i: number| no| nr|)[.:]{0,2}[ \t]{0,2})"
    r"\+?\d(?:[ .\-/]?\d){6,13}(?![\p{L}\p{N}_])"
)
_SECRET_WORD = (
    r"(?<=[=:\"'\s])(?=[A-Za-z0-9+/_\-]{8})(?<=(?i:token|secret|passw|pwd|api[ _\-]{0,1}key|[_\-]key)\w{0,12}[\"']{0,1}\s{0,2}[=:]\s{0,2}[\"']{0,1})"
    r"[A-Za-z0-9+/_\-]{8,}={0,2}"
)
# Kinds in order of precedence; at one place the first that fits is taken.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,62})\.){1,126}\p{L}{2,24}"),  # a domain has at most 253 characters
    ("secret", r"(?:(?<![A-Za-z0-9])(?=[Aegsx])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_\-]{16,}|xox[baprs]-[A-Za-z0-9\-]{10,}"
               r"|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,})(?![A-Za-z0-9])|" + _SECRET_WORD + ")"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    # a candidate; what no card word vouches for must also hold its check digit, and isn't part of a longer row of numbers
    ("card", r"(?=\d)(?<![\p{L}\p{N}_\-])(?:" + _CARD_WORD + r"|(?<!\d[.,])(?<!\d )(?:" + _CARD_SHAPES + r")(?![\p{L}\p{N}_]|[.,\-]\d| \d{4}(?!\d)))"),
    ("phone", r"(?=[+(\d])(?:(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\w)"
              r"|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w)|(?<![\w+.\-])(?:1[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
              r"|(?<![\w+.,/\-])(?<!\d )(?:(?:1 )?[2-9]\d{2} \d{3} \d{4}|0[1-9]\d{1,3}[ /\-]\d{5,8}|0[1-9]\d{1,3} [1-9]\d{2,3} \d{2,4}(?: \d{2})?"
              r"|0[1-9](?: \d{2}){4}|0[1-9](?:\.\d{2}){4}|0[1-9](?:-\d{2}){4})(?! ?\d)(?![\w\-]|[.,]\d)"
              r"|(?<![\p{L}\p{N}_+\-])" + _PHONE_WORD + ")"),
    ("name", r"(?<![\p{L}\p{N}])(?=[A-Zг])" + _TITLED),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
# Numbers that the words beside them vouch for.
VOUCHED = "|".join(f"(?:{p})" for p in (_SECRET_WORD, r"(?=\d)(?<![\p{L}\p{N}_\-])" + _CARD_WORD, r"(?=[+\d])(?<![\p{L}\p{N}_+\-])" + _PHONE_WORD))
# Texts without this hold no entity: numbers and mail addresses, then an opener of each title and secret; a first
# character class keeps the look at each place short.
HINT = (
    r"[@0-9]|(?=[A-Zг])(?:" + _TITLES + r"|AKIA)|(?=[egsx])(?:gh[pousr]_|sk-|xox[baprs]-|eyJ)"
    r"|(?=[tspaTSPA_\-])(?i:token|secret|passw|pwd|api[ _\-]?key|[_\-]key)"
)
STAYS = "stays"  # kind of a word inside a mention that isn't replaced
ROUNDS = 40  # draws before the format is taken to hold too few values


def may_hold_entities(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(HINT), F.lit(False))


def _kind(mention: Column) -> Column:
    """The first kind whose pattern covers the mention; what only context shows is a secret."""
    out = F.when(mention.rlike(r"^\+?\d(?:[ .\-/]?\d){6,13}$"), "phone").otherwise("secret")
    whole = dict(PATTERNS) | {"card": _LONG_NUMBER}
    for kind in reversed([k for k in whole if k != "secret"]):
        out = F.when(mention.rlike(f"^(?:{whole[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _canonical(kind: Column, mention: Column) -> Column:
    compact = F.upper(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    return (
        F.when(kind.isin("iban", "card", "phone", "ssn"), compact)
        .when(kind.isin("email"), F.lower(mention)).otherwise(mention)
    )


def _stream(*parts: Column) -> Column:
    """Keyed hexadecimal digits, 128 of them."""
    return F.sha2(F.concat_ws("\x1f", *parts), 512)


def _number(stream: Column, position: Column) -> Column:
    """A number below 2**20 for a position, from overlapping places of the stream."""
    return F.conv(F.substring(F.concat(stream, stream), (position * 5 % 128 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")


def _scramble(text: Column, stream: Column, keep: Column) -> Column:
    """Replace letters and digits from position keep on, each within its script and case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        out = c
        for letters in ALPHABETS:
            out = F.when(
                F.contains(F.lit(letters), c), F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))
            ).otherwise(out)
        digit = F.when((c != "0") & (i == keep), n % 9 + 1).otherwise(n % 10).cast("string")
        return F.when(i < keep, c).when(c.rlike("^[0-9]$"), digit).otherwise(out)

    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(characters, one), "")


def _luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string, its last digit counting single."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i.cast("int"), F.lit(1)).cast("int") * F.when(
        (n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _card(digits: Column, stream: Column) -> Column:
    body = _scramble(F.substring(digits, F.lit(1), F.length(digits) - 1), stream, F.lit(1))
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    off = F.when(_luhn_sum(digits) % 10 == 0, 0).otherwise(_number(stream, F.lit(23)) % 9 + 1)
    return F.concat(body, ((check + off) % 10).cast("string"))


def _octets(address: Column, stream: Column) -> Column:
    parts = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (_number(stream, i) % 254 + 1).cast("string"))
    return F.concat_ws(".", F.substring_index(address, ".", 1), F.array_join(parts, "."))


def _mail(address: Column, stream: Column) -> Column:
    local, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    ending = F.substring_index(domain, ".", -1)
    reserved = F.when(ending.isin("com", "net", "org"), F.concat(F.lit("example."), ending)).otherwise(F.lit("example.org"))
    host = F.concat(F.lit("m"), F.substring(_stream(F.lit("domain"), stream), 1, 6))
    return F.concat(_scramble(local, stream, F.lit(0)), F.lit("@"), host, F.lit("."), reserved)


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _surname(word: Column, stream: Column, attempt: Column) -> Column:
    def made(script: str) -> Column:
        parts = F.transform(F.sequence(F.lit(1), attempt + 3), lambda i: _pick(FAMILY_PARTS[script], _number(stream, i)))
        return F.initcap(F.array_join(parts, ""))

    return F.when(_script(word) == "cyrillic", made("cyrillic")).otherwise(made("latin"))


def _given(word: Column, gender: str, stream: Column, attempt: Column) -> Column:
    """A listed name; after a collision, listed names are joined, as in double names."""

    def made(script: str) -> Column:
        parts = F.transform(F.sequence(F.lit(0), attempt), lambda i: _pick(
            GIVEN[script, gender], _number(stream, i + 1)))
        return F.array_join(parts, "-")

    return F.when(_script(word) == "cyrillic", made("cyrillic")).otherwise(made("latin"))


def _surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    s = _stream(F.lit(key), kind, canon, attempt.cast("string"))
    phone_keep = F.when(F.length(canon) > 10, F.length(canon) - 10).otherwise(0)  # the country's digits stay
    out = _scramble(canon, s, F.when(kind == "iban", 2).when(kind == "phone", phone_keep).otherwise(0))
    # a hexadecimal secret stays one
    hexes = F.substring(F.concat(s, s), F.lit(1), F.length(canon))
    out = F.when((kind == "secret") & canon.rlike("^[0-9a-f]{8,128}$"), hexes).otherwise(out)
    for name, made in (
        ("email", _mail(canon, s)), ("card", _card(canon, s)), ("ip", _octets(canon, s)), ("family", _surname(canon, s, attempt)),
        ("given-f", _given(canon, "f", s, attempt)), ("given-m", _given(canon, "m", s, attempt)), ("given-n", _given(canon, "n", s, attempt)),
    ):
        out = F.when(kind == name, made).otherwise(out)
    return out


def _title(mention: Column) -> Column:
    return F.element_at(F.split(mention, _GAPS), 1)


def _gender(mention: Column) -> Column:
    title = F.regexp_replace(_title(mention), r"\.$", "")
    return F.when(title.isin(*FEMALE_TITLES), "f").when(title.isin(*MALE_TITLES), "m").otherwise("n")


def _name_parts(mention: Column) -> Column:
    """(kind, canonical form) of the words after a title; particles stay."""
    words = F.split(mention, _GAPS)
    names = F.slice(words, F.lit(2), F.size(words))
    last = F.size(names)
    return F.transform(names, lambda n, i: F.struct(
        F.when(n.isin(*PARTICLES), STAYS).when(i == last - 1, F.lit("family"))
        .otherwise(F.concat(F.lit("given-"), _gender(mention))).alias("kind"), n.alias("canon"),
    ))


def _untitled_parts(mention: Column, roles: Column) -> Column:
    """(kind, canonical form) of words that a title showed elsewhere in the text: the last one is a family name if it can be."""
    words = F.split(mention, _GAPS)
    last = F.size(words)

    def role(word: Column, i: Column) -> Column:
        own = F.filter(roles, lambda r: r["canon"] == word)
        likely = F.filter(own, lambda r: (r["kind"] == "family") == (i == last - 1))
        return F.element_at(F.concat(likely, own), 1)

    return F.transform(words, role)


def _parts(kind: Column, mention: Column, roles: Column) -> Column:
    """The pieces of a mention that are replaced one by one: (kind, canonical form)."""
    return F.when(kind == "name", _name_parts(mention)).when(kind == "untitled", _untitled_parts(mention, roles)).otherwise(
        F.array(F.struct(kind.alias("kind"), _canonical(kind, mention).alias("canon"))))


def _render(kind: Column, mention: Column, pieces: Column) -> Column:
    """Put the replacements into the mention's own format."""
    made = F.element_at(pieces, 1)
    slots = F.filter(F.split(mention, ""), lambda c: c != "")

    def fill(state: Column, c: Column) -> Column:
        filled = c.rlike(r"[\p{L}\p{N}]")
        piece = F.substring(made, state["n"] + 1, F.lit(1))
        piece = F.when(c.rlike(r"\p{Ll}"), F.lower(piece)).otherwise(piece)
        return F.struct(
            F.concat(state["text"], F.when(filled, piece).otherwise(c)).alias("text"),
            (state["n"] + filled.cast("int")).alias("n"),
        )

    spread = F.aggregate(slots, F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), fill, lambda s: s["text"])
    words = F.when(kind == "name", F.concat(F.array(_title(mention)), pieces)).otherwise(pieces)
    gaps = F.split(mention, r"[^\s\u00A0]+")
    gaps = F.slice(gaps, F.lit(2), F.size(gaps))
    named = F.array_join(F.flatten(F.zip_with(words, gaps, lambda w, g: F.array(w, F.coalesce(g, F.lit(""))))), "")
    return (
        F.when(kind.isin("name", "untitled"), named)
        .when(kind.isin("iban", "card", "phone", "ssn"), spread)
        .when((kind == "email") & (F.upper(mention) == mention), F.upper(made)).otherwise(made)
    )


def _pattern(names: Column) -> Column:
    """ANY, or one of a text's own names (joined by |) in a row."""
    return F.concat(
        F.lit(ANY + r"|(?<![\p{L}\p{N}]|\p{L}-)(?:"), names, F.lit(r")(?:[ \u00A0](?:"), names, F.lit(r")){0,2}(?![\p{L}\p{N}]|-\p{Lu})"),
    )


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, place, mention, kind, roles, names) of every distinct text's entities, in order.

    Names that a title shows anywhere in a text are found again without one; roles
    tells what their words are, names are the words themselves, joined by |.  A
    candidate that turns out to be no entity has a null kind and stays as it is.
    """
    titled = docs.where(may_hold_entities(text)).select(
        text_key(text).alias("text_key"), F.col(text).alias("whole"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("titled")
    )
    shown = F.filter("titled", lambda m: m.rlike(f"^{_TITLED}$"))
    known = titled.select(
        "*", F.filter(F.array_distinct(F.flatten(F.transform(shown, _name_parts))), lambda r: r["kind"] != STAYS).alias("roles"),
        F.when(F.exists("titled", lambda m: m.rlike(f"^{_LONG_NUMBER}$")), F.regexp_extract_all("whole", F.lit(VOUCHED), F.lit(0)))
        .otherwise(F.array().cast("array<string>")).alias("vouched"),
    ).withColumn("names", F.array_join(F.array_distinct(F.transform("roles", lambda r: r["canon"])), "|"))
    found = known.withColumn("found", F.when(
        F.col("names") != "", F.regexp_extract_all("whole", _pattern(F.col("names")), F.lit(0))).otherwise(F.col("titled")))
    each = F.transform("found", lambda m: F.struct(
        m.alias("mention"), F.filter("roles", lambda r: F.array_contains(F.split(m, _GAPS), r["canon"])).alias("roles"),
        F.array_contains("vouched", m).alias("vouched"),
    ))
    # posexplode_outer, as an inferred filter below a plain one would run the patterns again
    rows = found.select("text_key", "names", F.posexplode_outer(each).alias("place", "m")).where("m is not null")
    rows = rows.select("text_key", "names", "place", "m.*").distinct().withColumn("kind", _kind(F.col("mention")))
    is_card = F.col("vouched") | (_luhn_sum(F.regexp_replace("mention", "[^0-9]", "")) % 10 == 0)
    kind = F.when((F.col("kind") == "secret") & (F.size("roles") > 0), "untitled").when(
        (F.col("kind") != "card") | is_card, F.col("kind"))
    return rows.select("text_key", "place", "mention", kind.alias("kind"), "roles", "names")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon), with distinct surrogates that are no entities themselves.

    A format that has too few values for its entities (addresses keep their first
    number, short secrets their length) would be drawn for ever; after ``ROUNDS``
    rounds that is an error.
    """
    kind, canon = F.col("kind"), F.col("canon")
    # a given number of tasks: few bytes are much work here
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = entities.repartition(tasks, "kind", "canon").withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        drawn = materialize(drawn.select(
            "kind", "canon", "attempt", _surrogate(kind, canon, F.col("attempt"), key).alias("surrogate")
        ), "surrogates")
        # the smallest entity keeps a shared surrogate; lower case, so that no two differ by case alone
        shared = drawn.groupBy("kind", F.lower("surrogate").alias("s")).agg(F.min("canon").alias("keeper"), F.count("*").alias("n"))
        losers = drawn.withColumn("s", F.lower("surrogate")).join(shared.where("n > 1"), ["kind", "s"]).where("canon != keeper")
        real = entities.select("kind", F.lower("canon").alias("s")).distinct()
        real = drawn.withColumn("s", F.lower("surrogate")).join(real, ["kind", "s"], "left_semi")
        again = materialize(losers.select("kind", "canon").unionByName(real.select("kind", "canon")).distinct(), "redraw")
        if again.limit(1).count() == 0:
            return drawn.select("kind", "canon", "surrogate")
        drawn = drawn.join(again.withColumn("more", F.lit(1)), ["kind", "canon"], "left").select(
            "kind", "canon", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")
        )
    left = ", ".join(f"{r['count']} of kind {r['kind']}" for r in again.groupBy("kind").count().orderBy("kind").collect())
    raise RuntimeError(f"no distinct surrogates after {ROUNDS} draws: {left}")


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rewrite the text of every row and add ``n_entities``; all other columns stay."""
    base = without(docs, "n_entities")
    found = materialize(mentions(base, text), "mentions")
    pieces = found.where("kind is not null").select(
        "text_key", "place", "mention", "kind", "names",
        F.posexplode(_parts(F.col("kind"), F.col("mention"), F.col("roles"))).alias("piece", "part"),
    ).select("text_key", "place", "mention", "names", F.col("kind").alias("whole"), "piece", "part.kind", "part.canon")
    mapping = assign(pieces.select("kind", "canon").where(F.col("kind") != STAYS).distinct(), key)
    replaced = pieces.join(mapping, ["kind", "canon"], "left").withColumn("surrogate", F.coalesce("surrogate", "canon"))
    rendered = replaced.groupBy("text_key", "place", "mention", "whole", "names").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("piece", "surrogate"))), lambda p: p["surrogate"]).alias("pieces")
    ).select("text_key", "place", "names", _render(F.col("whole"), F.col("mention"), F.col("pieces")).alias("new"), F.lit(1).alias("n"))
    stays = found.where("kind is null").select("text_key", "place", "names", F.col("mention").alias("new"), F.lit(0).alias("n"))
    at, new, names, n = (unused(base, c) for c in ("_key", "_new", "_names", "_n"))
    by_text = rendered.unionByName(stays).groupBy(F.col("text_key").alias(at)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda p: p["new"]).alias(new),
        F.max("names").alias(names), F.sum("n").alias(n),
    )
    between = F.when(F.col(names) != "", F.split(F.col(text), _pattern(F.col(names)), -1)).otherwise(F.split(F.col(text), ANY, -1))
    rebuilt = F.array_join(F.flatten(F.zip_with(
        between, F.col(new), lambda a, b: F.array(a, F.coalesce(b, F.lit("")))
    )), "")
    has_hint = may_hold_entities(text)
    changed = base.where(has_hint).withColumn(at, text_key(text)).join(by_text, at, "left").select(
        *[(F.coalesce(F.when(F.col(new).isNotNull(), rebuilt), F.col(c)).alias(c) if c == text else F.col(f"`{c}`")) for c in base.columns],
        F.coalesce(n, F.lit(0)).cast("long").alias("n_entities"),
    )
    plain = base.where(~has_hint).withColumn("n_entities", F.lit(0).cast("long"))
    return changed.unionByName(plain)

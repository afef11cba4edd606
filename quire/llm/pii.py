"""PII surrogates in DataFrame functions: detected entities get keyed replacements of
the same type, gender, script and format.

Kinds: e-mail address, phone, IPv4, payment card (16 digits), social security number,
IBAN, secrets (hexadecimal, or behind a known prefix), and personal names (after a title,
before a Chinese honorific, or a known given name with a surname). A surrogate is a
function of the key, the kind and the entity's normal form alone, so an entity has the
same surrogate wherever it stands and however it is written (coreference). Names go word
by word: listed given names to given names of the same gender and script by a keyed
rotation, other first names behind a title to made-up names with an ending of the
gender that most of their titles in the table tell (a tie, or no such title: a neutral
one), surnames to made-up words. An address keeps its domain's identity; digits
keep their layout; cards keep their first digit and get a valid check digit, IBANs their
country and valid check digits; social security numbers have an area, group and serial
that can be issued; phones keep their country code or the two first digits of a trunk
prefix, secrets their known prefix.

Collision check: all distinct (kind, normal form) of the whole table are compared with all
surrogates; where two entities would get one surrogate, or a surrogate is an entity of
the table itself, all but the first take the next attempt, until none is left. So
distinct entities stay distinct.

Occurrences are joined to their surrogates under a salt, so an entity in a third of all
documents is many join keys; texts move only where they hold an entity.

Defined results: null text stays null with no entities, empty text empty; rows repeated
are replaced alike; other columns, of whatever name, are untouched.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import col, need, own, staged

SALTS = 16
#: Titles by gender, and given names by gender and script.
TITLES = {"m": "Mr Herr Monsieur Señor Sr", "f": "Mrs Ms Miss Frau Madame Mme Señora Sra", "": "Dr Prof"}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Hans Klaus Stefan Jürgen Pierre Jean Luc Antoine José Carlos Miguel Javier Mohamed Ahmed",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Emma Anna Ursula Monika Petra Claudia Marie Sophie Camille Chloé María Carmen Ana Lucía Fatima Aisha Olivia",
    "M": "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай",
    "F": "Анна Мария Елена Ольга Наталья Екатерина Татьяна Ирина",
    "γ": "Γιώργος Γιάννης Κώστας Δημήτρης Νίκος Παναγιώτης Βασίλης Χρήστος",
    "η": "Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Ιωάννα",
}
#: The syllables of made-up surnames, by script.
LATIN = "ba be bo da de do fa fe ga go ha he ja ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa zo".split()
CYRILLIC = "ба бе бо да де до ва ве га ге го жа за зе ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то фа ха ша".split()
GREEK = "βα βε γα γο δα δε ζα θε κα κε λα λο μα με να νο πα πε ρα ρο σα σε τα το φα χα".split()
#: Endings of made-up first names, by script and gender.
ENDINGS = {"latin": {"m": "rik", "f": "lina", "": "en"}, "cyrillic": {"m": "мир", "f": "мира", "": "ен"}, "greek": {"m": "νος", "f": "νια", "": "ι"}}
#: Chinese surnames, characters of given names and honorifics by gender.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗"
HAN_GIVEN = {"m": "伟强磊军勇杰涛明超刚平辉鹏斌波宇", "f": "芳娜敏静丽艳娟霞秀英华慧巧美玲雪"}
HONORIFICS = {"m": "先生", "f": "女士 小姐 太太"}
#: Prefixes of access keys and what follows them.
SECRET_PREFIXES = {"AKIA": "[A-Z0-9]{16}", "ASIA": "[A-Z0-9]{16}", "sk-": "[A-Za-z0-9]{20,64}", "ghp_": "[A-Za-z0-9]{36}"}

_O = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’\-]{1,30}"


def _any_of(words: str) -> str:
    """An alternation that branches on the first letter, so most places fail at once."""
    by: dict[str, list[str]] = {}
    for w in words.split():
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in by.items()) + ")"


_TITLES = _any_of(" ".join(TITLES.values()))
_GIVEN = _any_of(" ".join(GIVEN.values()))
_HONORIFICS = "|".join(" ".join(HONORIFICS.values()).split())
_KEYED = "|".join(p + rest for p, rest in SECRET_PREFIXES.items())
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9][A-Za-z0-9.\-]{0,200}\.[A-Za-z]{2,24}(?![A-Za-z])"
IP = rf"(?<![\d.])(?:{_O}\.){{3}}{_O}(?!\.?\d)"
CARD = r"(?<![\d\-])(?:\d{16}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4})(?![\d])"
PHONE = r"(?<![\w.+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}(?!\d)|(?<![\d\-.])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-])|(?<![\d\-.])07\d{3} \d{6}(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
IBAN = r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = rf"(?<![A-Za-z0-9])(?:(?=[A-Fa-f0-9]{{16}})(?=[0-9]{{0,63}}[A-Fa-f])(?=[A-Fa-f]{{0,63}}[0-9])[A-Fa-f0-9]{{16,64}}|(?=[Asg])(?:{_KEYED}))(?![A-Za-z0-9])"
CASED = rf"(?=\p{{Lu}})(?<![\p{{L}}])(?:{_TITLES}\.? {_NAME}(?: {_NAME})?|{_GIVEN}(?: {_NAME}){{1,2}})"
HAN = rf"(?=[\u4E00-\u9FFF])[{HAN_SURNAMES}]\p{{IsHan}}{{1,2}}(?:{_HONORIFICS})"
PERSON = rf"(?:{CASED}|{HAN})"
KINDS = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("ssn", SSN), ("iban", IBAN), ("secret", SECRET), ("person", PERSON))
#: All kinds, those that start alike behind one look at the first character.
ANY = rf"(?:{EMAIL})|(?=[0-9])(?:{IP}|{CARD}|(?:{PHONE})|{SSN})|(?=[+(])(?:{PHONE})|(?:{SECRET})|(?=\p{{Lu}})(?:{IBAN}|{CASED})|{HAN}"


def numbered(text: Column) -> Column:
    """Whether a text can hold any kind but a name: all others have a digit, an @ or a
    key's prefix."""
    return _holds(text, SECRET_PREFIXES) | F.rlike(text, F.lit("[0-9@]"))


def _holds(text: Column, strings: Iterable[str]) -> Column:
    """Whether one of some strings stands in a text: a search of bytes, no pattern."""
    return reduce(or_, (text.contains(s) for s in strings))


def _private(text: Column) -> Column:
    """Whether a text holds an entity; a pattern runs only where it can match."""
    named = F.rlike(text, F.lit(CASED)) | (_holds(text, _HONORIFICS.split("|")) & F.rlike(text, F.lit(HAN)))
    return F.when(numbered(text), F.rlike(text, F.lit(ANY))).otherwise(named)


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.when(numbered(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)))


def kind_of(entity: Column) -> Column:
    out = F.lit("person")
    for name, pattern in reversed(KINDS[:-1]):
        # an entity stands alone here, so what looks around it holds trivially
        out = F.when(entity.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    return out


def parts(entity: Column) -> Column:
    """What is replaced in an entity: an array of (kind, normal form, as written)."""
    kind = kind_of(entity)
    digits = F.regexp_replace(entity, r"\D", "")
    norm = F.when(kind == "email", F.lower(entity)).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(entity)
    one = F.array(F.struct(kind.alias("kind"), norm.alias("norm"), entity.alias("said")))
    given = [(g, F.array(*map(F.lit, names.split()))) for g, names in GIVEN.items()]

    def word(w: Column) -> Column:
        k = F.when(F.rlike(w, F.lit(rf"\A(?:{_TITLES})\.?\z")), F.lit("title"))
        for g, names in given:
            k = k.when(F.array_contains(names, w), F.lit(f"given {g}"))
        return F.struct(k.otherwise(F.lit("surname")).alias("kind"), w.alias("norm"), w.alias("said"))

    part = lambda k, w: F.struct(k.alias("kind"), w.alias("norm"), w.alias("said"))
    words = F.transform(F.split(entity, " "), word)
    # title, first name, surname: the title tells the gender of a name that is not listed
    title = F.regexp_replace(words[0]["norm"], r"\.", "")
    first = F.concat(F.lit("first "), _gender(title, TITLES))
    named = F.when((F.size(words) == 3) & (words[0]["kind"] == "title") & (words[1]["kind"] == "surname"), F.array(words[0], part(first, words[1]["norm"]), words[2])).otherwise(words)
    called, honorific = F.regexp_extract(entity, rf"\A(.*?)({_HONORIFICS})\z", 1), F.regexp_extract(entity, rf"\A(.*?)({_HONORIFICS})\z", 2)
    han = F.array(part(F.concat(F.lit("han "), _gender(honorific, HONORIFICS)), called), part(F.lit("title"), honorific))
    return F.when(kind != "person", one).when(_han(entity), han).otherwise(named)


def _gender(title: Column, titles: dict[str, str]) -> Column:
    out = F.lit("")
    for gender in "mf":
        out = F.when(title.isin(titles[gender].split()), gender).otherwise(out)
    return out


def _han(entity: Column) -> Column:
    return F.rlike(entity, F.lit(r"\A\p{IsHan}"))


def gendered(strings: DataFrame) -> DataFrame:
    """``strings`` with one kind for each unlisted first name: the gender that most of
    its entities' titles tell, neutral on a tie or without such a title."""
    first = F.col("kind").startswith("first")
    sides = [F.count_if(F.col("kind") == f"first {g}") for g in "mf"]
    votes = strings.where(first).groupBy(F.col("norm").alias("voted")).agg((sides[0] - sides[1]).alias("lead"))
    told = F.when(F.col("lead") > 0, "first m").when(F.col("lead") < 0, "first f").otherwise("first ")
    out = strings.join(votes, first & (F.col("norm") == F.col("voted")), "left")
    return out.withColumn("kind", F.when(first, told).otherwise(F.col("kind"))).drop("voted", "lead")


def _byte(h: Column, i: Column) -> Column:
    """The i-th pseudo-random number (0 to 65535) of a hex digest of 128 digits."""
    return F.conv(F.substring(h, (i % 62) * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _stream(key: str, *what: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *what).cast("binary"), 512)


def _like(s: Column, h: Column) -> Column:
    """Letters and digits of ``s`` replaced within their class, the rest kept."""
    def each(c: Column, i: Column) -> Column:
        n = _byte(h, i) + i
        out = F.when(F.rlike(c, F.lit("[0-9]")), (n % 10).cast("string"))
        out = out.when(F.rlike(c, F.lit("[a-z]")), F.char(n % 26 + 97)).when(F.rlike(c, F.lit("[A-Z]")), F.char(n % 26 + 65))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), each), "")


def _hex_like(s: Column, h: Column) -> Column:
    """Hexadecimal digits of the same case."""
    lower = F.lit("0123456789abcdef")
    made = F.array_join(F.transform(F.split(s, ""), lambda c, i: F.substring(lower, _byte(h, i) % 16 + 1, F.lit(1))), "")
    return F.when(F.rlike(s, F.lit("[A-F]")), F.upper(made)).otherwise(made)


def _digits(norm: Column, keep: Column, h: Column) -> Column:
    """As many digits, the first ``keep`` kept."""
    rest = F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: F.when(i <= keep, F.substring(norm, i, F.lit(1))).otherwise((_byte(h, i) % 10).cast("string")))
    return F.array_join(rest, "")


def _check_digit(first15: Column) -> Column:
    doubled = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substring(first15, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return ((10 - total % 10) % 10).cast("string")


def _country(said: Column) -> Column:
    """How many leading digits of a phone stay: its country code, or a trunk prefix."""
    return F.length(F.regexp_extract(said, r"\A(?:\+(?=\d)|\(?(?=0))(\d{1,3})", 1)) - F.when(F.rlike(said, F.lit(r"\A\(?0\d\d")), 1).otherwise(0)


def _ssn(h: Column) -> Column:
    """An area of 001 to 899 but 666, a group of 01 to 99, a serial of 0001 to 9999."""
    area = _byte(h, F.lit(0)) % 898 + 1
    area = F.when(area >= 666, area + 1).otherwise(area)
    return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lpad((_byte(h, F.lit(2)) % 99 + 1).cast("string"), 2, "0"), F.lpad((_byte(h, F.lit(4)) % 9999 + 1).cast("string"), 4, "0"))


def _iban(norm: Column, h: Column) -> Column:
    """The same country, an account of the same layout, check digits by modulo 97."""
    country, account = F.substring(norm, 1, 2), _like(F.substring(norm, F.lit(5), F.length(norm)), h)
    spelt = F.split(F.concat(account, country, F.lit("00")), "")
    left = F.aggregate(spelt, F.lit(0), lambda s, c: F.when(F.rlike(c, F.lit("[0-9]")), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), account)


def _secret(norm: Column, h: Column) -> Column:
    """A key's prefix and letters and digits alike, or hexadecimal digits."""
    out = _hex_like(norm, h)
    for p in SECRET_PREFIXES:
        out = F.when(norm.startswith(p), F.concat(F.lit(p), _like(F.substring(norm, F.lit(len(p) + 1), F.length(norm)), h))).otherwise(out)
    return out


def canonical(key: str, kind: Column, norm: Column, said: Column, attempt: Column) -> Column:
    """The surrogate's normal form."""
    h = _stream(key, kind, norm, attempt.cast("string"))
    domain = F.substring_index(norm, "@", -1)
    labels = F.regexp_extract(domain, r"\A(.*)\.([^.]+)\z", 1)
    tld = F.substring_index(domain, ".", -1)
    email = F.concat(_like(F.substring_index(norm, "@", 1), h), F.lit("@"), _like(labels, _stream(key, F.lit("domain"), domain)), F.lit("."), tld)
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when((i == 0) & F.rlike(norm, F.lit(r"\A(?:10|127)\.")), F.substring_index(norm, ".", 1)).otherwise((_byte(h, i) % F.when(i == 0, 222).otherwise(254) + 1).cast("string")))
    head = F.substring(_digits(norm, F.lit(1), h), 1, 15)
    out = F.when(kind == "email", email).when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", F.concat(head, _check_digit(head)))
    out = out.when(kind == "phone", _digits(norm, _country(said), h)).when(kind == "ssn", _ssn(h))
    out = out.when(kind == "iban", _iban(norm, h)).when(kind == "secret", _secret(norm, h))
    for g, names in GIVEN.items():
        names = names.split()
        shift = _byte(_stream(key, F.lit(f"given {g}")), F.lit(0)) % (len(names) - 1) + 1
        all_names = F.array(*map(F.lit, names))
        out = out.when(kind == f"given {g}", F.element_at(all_names, ((F.array_position(all_names, norm) - 1 + shift) % len(names) + 1).cast("int")))
    scripts = {"cyrillic": CYRILLIC, "greek": GREEK, "latin": LATIN}
    script = F.when(F.rlike(norm, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(norm, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")

    def joined(known: list[str] | str, many: Column) -> Column:
        pick = lambda i: F.element_at(F.array(*map(F.lit, known)), _byte(h, i - 1) % len(known) + 1)
        return F.array_join(F.transform(F.sequence(F.lit(1), many), pick), "")

    def syllables(few: int) -> Column:
        made = F.lit(None)
        for name, known in scripts.items():
            made = F.when(script == name, F.initcap(joined(known, attempt + few))).otherwise(made)
        return made

    ending = F.lit("")
    for name, ends in ENDINGS.items():
        for gender, end in ends.items():
            ending = F.when((script == name) & (kind == f"first {gender}"), end).otherwise(ending)
    made = F.when(kind == "surname", syllables(3)).otherwise(F.concat(syllables(2), ending))
    made = F.when(F.rlike(norm, F.lit(r"\A[^\p{Ll}]{2,}\z")), F.upper(made)).otherwise(made)
    shift = _byte(_stream(key, F.lit("han")), F.lit(0)) % (len(HAN_SURNAMES) - 1) + 1
    family = F.substring(F.lit(HAN_SURNAMES), (F.instr(F.lit(HAN_SURNAMES), F.substring(norm, 1, 1)) - 1 + shift) % len(HAN_SURNAMES) + 1, F.lit(1))
    for g, chars in HAN_GIVEN.items():
        out = out.when(kind == f"han {g}", F.concat(family, joined(chars, F.length(norm) - 1 + F.floor(attempt / 8).cast("int"))))
    return out.when((kind == "surname") | kind.startswith("first"), made).otherwise(norm)


def dressed(kind: Column, said: Column, made: Column) -> Column:
    """A surrogate's normal form in the layout in which its entity was written."""
    layout = F.aggregate(F.split(said, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda a, c: F.when(F.rlike(c, F.lit("[A-Z0-9]" )), F.struct(F.concat(a["out"], F.substring(made, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))))["out"]
    upper = F.rlike(said, F.lit("[A-Z]")) & ~F.rlike(said, F.lit("[a-z]"))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), layout).when((kind == "email") & upper, F.upper(made)).otherwise(made)


def assigned(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, made) for distinct (kind, norm, said): no two of a kind alike, none an
    entity of the table. Each round keeps the first of those that collide."""
    at = found.select("kind", "norm", "said").groupBy("kind", "norm").agg(F.min("said").alias("said")).withColumn("attempt", F.lit(0))
    # rotations of given names and titles cannot collide, and may name each other
    free = lambda d: F.col(f"{d}kind").startswith("given") | (F.col(f"{d}kind") == "title")
    at = staged(at.withColumn("made", canonical(key, F.col("kind"), F.col("norm"), F.col("said"), F.col("attempt"))), "surrogates")
    real = at.select(F.col("kind").alias("k"), F.col("norm").alias("made"))
    while True:
        first = at.where(~free("")).groupBy("kind", "made").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("attempt"), F.col("norm"))).alias("x"))
        taken = at.join(real, (F.col("kind") == F.col("k")) & (at["made"] == real["made"]), "left_semi").where(~free("")).select("kind", "made").distinct().withColumn("real", F.lit(True))
        bad = first.join(taken, ["kind", "made"], "left").where("n > 1 or real").select("kind", "made", F.when(F.col("real"), F.lit(None)).otherwise(F.col("x.norm")).alias("stays"))
        bad = staged(bad, "collisions")
        if bad.isEmpty():
            return at.select("kind", "norm", "made")
        again = at.join(bad, ["kind", "made"], "left").select("kind", "norm", "said", (F.col("attempt") + F.when(bad["kind"].isNotNull() & ~F.coalesce(F.col("stays") == F.col("norm"), F.lit(False)), 1).otherwise(0)).alias("attempt"))
        at = staged(again.withColumn("made", canonical(key, F.col("kind"), F.col("norm"), F.col("said"), F.col("attempt"))), "surrogates")


def replaced(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and two more columns: n_entities, and kinds
    (kinds of the entities in order). ``key`` stands in the plan: show it to nobody."""
    need(docs, doc_id, text)
    raw, mark, made_by, kinds = col(text).cast("string"), own("key"), own("made"), own("kinds")
    has = F.coalesce(_private(raw), F.lit(False))
    base = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    mine = F.md5(F.concat_ws("\u0001", F.coalesce(col(doc_id).cast("string"), F.lit("")), raw).cast("binary"))
    hits = docs.where(has).select(mine.alias("mark"), entities(raw).alias("e")).dropDuplicates(["mark"])
    hits = staged(hits, "entities")
    strings = staged(hits.select(F.explode("e").alias("entity")).distinct().select("entity", F.posexplode(parts(F.col("entity"))).alias("at", "part")).select("entity", "at", "part.*"), "parts")
    strings = gendered(strings)
    made = assigned(strings, key)
    whole = strings.join(made, ["kind", "norm"]).select("entity", "at", "kind", dressed(F.col("kind"), F.col("said"), F.col("made")).alias("made"))
    whole = whole.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "made"))).alias("p"))
    whole = whole.select("entity", F.when(_han(F.col("entity")), F.array_join(F.col("p.made"), "")).otherwise(F.array_join(F.col("p.made"), " ")).alias("made"), F.when(F.size("p") > 1, "person").otherwise(F.col("p")[0]["kind"]).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = hits.select("mark", F.posexplode("e").alias("at", "entity")).withColumn("salt", F.pmod(F.xxhash64("mark", "at"), F.lit(SALTS)).cast("int"))
    each = each.join(whole, ["entity", "salt"]).groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("at", "made", "kind"))).alias("x"))
    each = each.select(F.col("mark").alias(mark), F.col("x.made").alias(made_by), F.col("x.kind").alias(kinds))
    rest = docs.where(~has).select(*map(col, base), F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    cut = F.when(numbered(raw), F.split(raw, ANY, -1)).otherwise(F.split(raw, PERSON, -1))
    new = F.array_join(F.zip_with(cut, F.concat(F.col(made_by), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    some = docs.where(has).select(*map(col, base), mine.alias(mark)).join(each, mark)
    some = some.select(*[new.alias(text) if c == text else col(c) for c in base], F.size(made_by).alias("n_entities"), F.col(kinds).alias("kinds"))
    return some.unionByName(rest)

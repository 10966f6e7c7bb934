"""Personal data replaced by surrogates of the same kind.

Entities are found by one pattern over the whole text: e-mail addresses, names after a title (any number of words, with initials and particles), IPv4
addresses, bank account numbers (IBAN), payment cards, phone and social security numbers, and secrets to the
end of their run or quotes. The family name of a titled name is also replaced where the same document has it without
a title; these mentions are not counted as entities. A
surrogate is drawn from a keyed hash of the entity's normal form, so that one entity has one surrogate
everywhere, also where it is written otherwise (`+1 (456) 555-2186` and `+1 456 555 2186`, `Mrs Anna Berg`
and `Mrs. Berg`), and it keeps kind, gender, script and format: signs stay in place, digits become digits
and letters letters of their case; country codes, card networks, key prefixes and check sums hold.

Distinctness: all distinct entities of the input are drawn for, and where two of a kind would get one
surrogate, or one would get another's real value, the later is drawn for again until none is left. Mailboxes and hosts are
drawn apart, a mailbox among those of its host. Where a form has no more values than there are entities, further draws are
longer: by a sign for mailboxes and names, for phone numbers and secrets from the third draw on. Those
few are joined back by document. The text is cut at its entities once and put together with the surrogates,
so no surrogate is ever matched again. All of it is Spark's own expressions.

Nulls: a null text stays null, and an empty one empty. Rows with a null doc_id and repeated rows are
treated like others. An empty table gives an empty result. `replace_personal_data` keeps docs' own columns,
whatever their names, and changes `text` only, and `n_chars`, if there, to the new length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, cut, table

KEY = "surrogate-key-1"
#: Draws for an entity before the run fails; each round leaves a small part of the last one's clashes.
MOST_DRAWS = 40
#: Draws in which secrets and phone numbers keep their length; later ones add a sign each.
FORMED_DRAWS = 2

# Titles by gender.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
NEUTRAL_TITLES = ("Dr", "Prof", "Professor")
# Words within a name that stay.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "ben", "ter", "ten", "zu", "zum", "und", "y", "e", "af", "av", "фон", "де", "ван")
# Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "m"): ("Adam", "Anton", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Noah", "Oscar"),
    ("latin", "f"): ("Alice", "Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Тимур"),
    ("cyrillic", "f"): ("Алла", "Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"),
    ("greek", "m"): ("Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Ιάσων", "Κώστας", "Λάμπρος", "Μιχάλης", "Νίκος", "Πέτρος", "Σπύρος", "Στέλιος", "Τάσος", "Φώτης"),
    ("greek", "f"): ("Αγγελική", "Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ειρήνη", "Ζωή", "Ιωάννα", "Κατερίνα", "Λένα", "Μαρία", "Νίκη", "Ξένια", "Ρένα", "Σοφία", "Χρύσα"),
}
GIVEN |= {(script, "n"): GIVEN[script, "m"] + GIVEN[script, "f"] for script in ("latin", "cyrillic", "greek")}
SYLLABLES = {
    "latin": ("ba", "bel", "cor", "da", "den", "fal", "gar", "hol", "ker", "lan", "lo", "mar", "mi", "nor", "or", "per", "ral", "sa", "ser", "tan", "tor", "val", "ven", "wil"),
    "cyrillic": ("ба", "бел", "вор", "гар", "да", "ден", "зор", "кал", "ла", "лев", "ло", "мар", "ми", "нов", "ор", "пет", "рад", "са", "сер", "тан", "тор", "фал", "хол", "чер"),
    "greek": ("βα", "βελ", "γα", "δα", "δημ", "ζα", "θα", "καλ", "κορ", "λα", "λο", "μαρ", "μι", "νικ", "ξε", "παπ", "ρα", "σα", "σερ", "ταν", "τορ", "φα", "χα", "ψα"),
}

# Letters that stand for others of their script and case, the first that match; any other letter becomes a Latin one.
ALPHABETS = {
    "[\\p{IsCyrillic}&&\\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "\\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    "[\\p{IsGreek}&&\\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "\\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    "\\p{IsHan}": "一二三四五六七八九十人大小中山川田日月火水木金土王石竹米花草",
    "\\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    "\\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    "\\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조초",
    "\\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "\\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    "\\p{Lu}": UPPER,
    "\\p{L}": LOWER,
    "\\p{N}": "0123456789",
}

_ONE_OF = lambda *words: "|".join(sorted(sum(words, ()), key=len, reverse=True))
_TITLES = _ONE_OF(MALE_TITLES, FEMALE_TITLES, NEUTRAL_TITLES)
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Repeats are possessive, which Java matches in a loop, so that long runs don't exhaust the stack.
_NAME = "\\p{Lu}(?:['’]\\p{Lu})?[\\p{L}\\p{M}]++(?:['’]\\p{Lu}[\\p{L}\\p{M}]++|-\\p{L}[\\p{L}\\p{M}]*+)*+"
_INITIAL = "\\p{Lu}(?:\\.-?\\p{Lu})*+\\.?"
_BEFORE = f" (?:(?:{_ONE_OF(NEUTRAL_TITLES)})\\.?|{_INITIAL}|{_ONE_OF(PARTICLES)})(?= )"
_EMAIL = "[\\p{L}\\p{N}._%+-]{1,64}@[\\p{L}\\p{N}-]{1,63}(?:\\.[\\p{L}\\p{N}-]{1,63})+"
_KEYED = "(?:password|passwd|pwd|token|secret|api_key) ?[=:] ?"
_QUOTED = lambda q: f"{q}(?!(?:[^{q}\\\\\r\n]|\\\\.){{0,7}}{q})(?=[^{q}\\r\\n]*[\\p{{L}}\\p{{N}}])(?:[^{q}\\\\\r\n]++|\\\\.)++{q}"
_VALUE = f"(?:{_QUOTED(chr(34))}|{_QUOTED(chr(39))}|[\"']?(?!{_EMAIL}(?![^\\s\"'.,;:!?)]))(?=[^\\s\"']*[\\p{{L}}\\p{{N}}])[^\\s\"']{{8,}}[\"']?)"
PATTERNS = {
    "email": f"(?<![\\p{{L}}\\p{{N}}._%+-]){_EMAIL}",
    "name": f"(?<![\\p{{L}}\\p{{N}}])(?:{_TITLES})\\.?(?:(?:{_BEFORE})*+ {_NAME})++",
    "secret": f"(?<![\\p{{L}}\\p{{N}}_])(?:AKIA[0-9A-Z]{{16}}(?![0-9A-Za-z])|ghp_[0-9A-Za-z]{{36,}}|sk-[0-9A-Za-z]{{20}}[0-9A-Za-z_-]*|{_KEYED}{_VALUE})",
    "iban": "(?<![\\p{L}\\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}\\p{N}])",
    "ip": f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9]|\\.[0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "(?<![0-9+])\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9+])(?:\\([0-9]{3}\\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": "(?<![0-9.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
_ANY = lambda *kinds: "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
#: All kinds but e-mail, behind a look at the first sign, without which the patterns cost four times as much.
UNMAILED = f"(?=[0-9+(])(?:{_ANY('ip', 'ssn', 'phone', 'card')})|(?=\\p{{Lu}})(?:{_ANY('name', 'iban')})|(?=[Agspta])(?:{_ANY('secret')})"
ENTITY = f"(?:{PATTERNS['email']})|{UNMAILED}"
_SECRET_HEAD = "^(?:[A-Za-z_]+ ?[=:] ?[\"']?)?(?:AKIA|ghp_|sk-)?"
#: Signs after a secret, as of a sentence that it ends.
_SECRET_TAIL = "[^\\p{L}\\p{N}]*$"


def let(value: Column, then) -> Column:
    """then(value), with value written into the plan once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def kind_of(v: Column) -> Column:
    """Which of the patterns an entity is of."""
    return (
        F.when(v.rlike(f"^{_KEYED}"), "secret")
        .when(v.contains("@"), "email")
        .when(v.rlike(f"^(?:{_TITLES})\\.? "), "name")
        .when(v.rlike("^(?:AKIA|ghp_|sk-)"), "secret")
        .when(v.rlike("^[A-Z]"), "iban")
        .when(v.rlike("^[0-9]+(?:\\.[0-9]+){3}$"), "ip")
        .when(v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(v.rlike("^[+(]|^[0-9]{3}[.-]"), "phone")
        .otherwise("card")
    )


# The public plan of country calling codes; all others have three digits.
CALLING_CODE = "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def phone_form(v: Column) -> Column:
    """All digits behind a + for numbers with a country code; those of code 1 and others by their last ten."""
    digits = only_digits(v)
    return let(digits, lambda d: F.when(v.startswith("+") & ~(d.startswith("1") & (F.length(d) == 11)), F.concat(F.lit("+"), d)).otherwise(F.right(d, F.lit(10))))


def only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def normal_form(kind: Column, v: Column) -> Column:
    """What all writings of an entity have in common. A name's is that of its family name; see name_parts."""
    return (
        F.when(kind == "mailbox", F.lower(v))
        .when(kind == "host", F.substring_index(F.lower(v), "@", -1))
        .when(kind == "secret", F.regexp_replace(F.regexp_replace(v, _SECRET_HEAD, ""), _SECRET_TAIL, ""))
        .when(kind == "iban", F.replace(v, F.lit(" "), F.lit("")))
        .when(kind == "ip", v)
        .when(kind == "phone", phone_form(v))
        .otherwise(only_digits(v))
    )


def name_parts(v: Column) -> Column:
    """(kind, norm) of each word of a name after its title: given names, and the family name last. Kinds tell gender and
    script; those of initials, and of further titles and particles, which stay, are no entities of their own."""
    titles = lambda words: F.transform(words, lambda w: F.regexp_replace(w, "\\.$", ""))
    gender = lambda t: F.when(F.arrays_overlap(t, F.array(*map(F.lit, MALE_TITLES))), "m").when(F.arrays_overlap(t, F.array(*map(F.lit, FEMALE_TITLES))), "f").otherwise("n")
    script = lambda w: F.when(w.rlike("\\p{IsCyrillic}"), "cyrillic").when(w.rlike("\\p{IsGreek}"), "greek").otherwise("latin")
    kinds = lambda words: F.struct(F.size(words).alias("n"), script(F.element_at(words, -1)).alias("script"), gender(titles(words)).alias("gender"))

    def part(w: Column, i: Column, of: Column) -> Column:
        kind = (
            F.when(i == of["n"] - 2, F.concat(F.lit("family_"), of["script"]))
            .when(w.rlike(f"^(?:(?:{_ONE_OF(NEUTRAL_TITLES)})\\.?|{_ONE_OF(PARTICLES)})$"), "kept")
            .when(w.rlike(f"^{_INITIAL}$"), "initial")
            .otherwise(F.concat_ws("_", F.lit("given"), of["script"], of["gender"]))
        )
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k.isin("kept", "initial"), w).otherwise(F.lower(w)).alias("norm")))

    return let(F.split(v, " "), lambda words: let(kinds(words), lambda of: F.transform(F.slice(words, F.lit(2), F.size(words) - 1), lambda w, i: part(w, i, of))))


def stream(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    """64 hex digits that only the key's holder can foresee."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, norm, draw.cast("string")), 256)


def number(hexes: Column, i: Column) -> Column:
    """The i-th number, 0 to 255, of a stream."""
    return F.conv(F.substring(hexes, F.pmod(i, F.lit(32)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7


def signs_of(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def same_classes(v: Column, hexes: Column, hexadecimal: bool = True) -> Column:
    """v with each digit and letter changed to one of its class, hex strings to hex digits if so asked; see ALPHABETS for other scripts."""
    letters = F.when(v.rlike("^[0-9a-f]+$"), 6).otherwise(26) if hexadecimal else F.lit(26)

    def other(c: Column, n: Column) -> Column:
        out = c
        for pattern, alphabet in reversed(ALPHABETS.items()):
            out = F.when(c.rlike(pattern), F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    def stepped(c: Column, n: Column) -> Column:
        at = F.pmod(n, letters).cast("int") + 1
        new = F.when(c.between("0", "9"), F.pmod(n, F.lit(10)).cast("string")).when(c.between("a", "z"), F.substring(F.lit(LOWER), at, F.lit(1))).when(c.between("A", "Z"), F.substring(F.lit(UPPER), at, F.lit(1)))
        return new.when(c <= "\x7f", c).otherwise(other(c, n))

    return F.array_join(F.transform(signs_of(v), lambda c, i: let(number(hexes, i), lambda n: stepped(c, n))), "")


def grown(v: Column, draw: Column, free: int = 0) -> Column:
    """v with one more sign of its last letter's or digit's class for each draw beyond the free ones, so that there are always
    more surrogates than values of one form."""
    last = F.regexp_extract(v, "([\\p{L}\\p{N}])[^\\p{L}\\p{N}]*$", 1)
    return F.when(draw > free, F.concat(v, F.repeat(F.when(last == "", "x").otherwise(last), draw - free))).otherwise(v)


def lay_digits(v: Column, digits: Column) -> Column:
    """v with its digits replaced by those of the string digits, in order; digits beyond v's own come behind its last digit's place."""

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(signs_of(v), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: F.concat(acc["out"], F.substring(digits, acc["i"] + 1, F.length(digits))))


def luhn(digits: Column) -> Column:
    """Check sum mod 10 of a card number; 0 if it is valid."""
    turned = F.reverse(signs_of(digits))

    def add(acc: Column, c: Column) -> Column:
        d = c.try_cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((acc["s"] + F.when(acc["odd"], twice).otherwise(d)).alias("s"), (~acc["odd"]).alias("odd"))

    return F.pmod(F.aggregate(turned, F.struct(F.lit(0).alias("s"), F.lit(False).alias("odd")), add, lambda acc: acc["s"]), F.lit(10))


def card_digits(norm: Column, hexes: Column) -> Column:
    """The first digit stays, and so does what the check sum says."""
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.pmod(number(hexes, i), F.lit(10)).cast("string")), "")
    new = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(1), F.length(norm) - 1))
    return let(new, lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 1), F.pmod(F.right(d, F.lit(1)).cast("int") + luhn(norm) - luhn(d), F.lit(10)).cast("string")))


def iban_digits(norm: Column, hexes: Column) -> Column:
    """Country stays, the account is drawn, and the two check digits make it valid."""
    return let(same_classes(F.substring(norm, F.lit(5), F.length(norm)), hexes), lambda account: with_check_digits(F.substring(norm, 1, 2), account))


def with_check_digits(country: Column, account: Column) -> Column:
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(signs_of(F.concat(account, country, F.lit("00"))), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int") + 1)


def drawn_name(kind: Column, hexes: Column, draw: Column) -> Column:
    """A given name of the kind's script and gender, or a family name. Each draw adds a given name or a syllable, so
    that there are always more surrogates than names."""
    n = F.transform(F.sequence(F.lit(0), draw + 3), lambda i: number(hexes, i))

    def named(n: Column) -> Column:
        out = F.lit(None).cast("string")
        for (script, gender), names in GIVEN.items():
            out = F.when(kind == f"given_{script}_{gender}", F.array_join(F.transform(F.slice(n, F.lit(1), draw + 1), lambda i: pick(names, i)), "-")).otherwise(out)  # noqa: B023
        for script, syllables in SYLLABLES.items():
            out = F.when(kind == f"family_{script}", F.initcap(F.array_join(F.transform(n, lambda i: pick(syllables, i)), ""))).otherwise(out)  # noqa: B023
        return out

    return let(n, named)


def drawn(kind: Column, norm: Column, draw: Column, key: str = KEY) -> Column:
    """The surrogate of a normal form, in normal form."""
    return let(stream(key, kind, norm, draw), lambda hexes: drawn_from(kind, norm, hexes, draw, key))


def drawn_from(kind: Column, norm: Column, hexes: Column, draw: Column, key: str) -> Column:
    user, host = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    number_of = lambda v: same_classes(grown(v, draw, FORMED_DRAWS), hexes)
    code = F.regexp_extract(F.substring(norm, F.lit(2), F.length(norm)), CALLING_CODE, 0)
    abroad = let(code, lambda c: F.concat(F.lit("+"), c, number_of(F.substring(norm, F.length(c) + 2, F.length(norm)))))
    return (
        F.when(kind == "mailbox", F.concat(same_classes(grown(user, draw), hexes, hexadecimal=False), F.lit("@@"), host))
        .when(kind == "host", F.concat(F.substring(hexes, F.lit(1), draw + 8), F.lit(".example.org")))
        .when(kind == "secret", number_of(norm))
        .when(kind == "iban", iban_digits(norm, hexes))
        .when(kind == "ip", F.concat_ws(".", F.when(draw == 0, "10").otherwise(number(hexes, F.lit(3)).cast("string")), *(number(hexes, F.lit(i)).cast("string") for i in range(3))))
        .when(kind == "card", card_digits(norm, hexes))
        .when((kind == "phone") & norm.startswith("+"), abroad)
        .when(kind == "phone", number_of(norm))
        .when(kind == "ssn", same_classes(norm, hexes))
        .otherwise(drawn_name(kind, hexes, draw))
    )


def lookup(redrawn: Column, kind: Column, norm: Column) -> Column:
    """Number of the draw that holds: 0 but for those few in the map redrawn."""
    return F.coalesce(F.element_at(redrawn, F.concat_ws("|", kind, norm)), F.lit(0))


def part_surrogate(p: Column, redrawn: Column, key: str = KEY) -> Column:
    """What a given or family name (kind, norm) is replaced by."""
    return let(lookup(redrawn, p["kind"], p["norm"]), lambda n: drawn_name(p["kind"], stream(key, p["kind"], p["norm"], n), n))


def bare_names_replaced(text: Column, found: Column, redrawn: Column, key: str = KEY) -> Column:
    """text, which lies between entities, with the family names of those found replaced where they stand without a title."""
    family = lambda v: F.struct(F.element_at(F.split(v, " "), -1).alias("word"), F.element_at(name_parts(v), -1).alias("part"))
    names = F.array_distinct(F.transform(F.filter(found, lambda v: kind_of(v) == "name"), family))
    alone = lambda w: F.concat(F.lit("(?<![\\p{L}\\p{N}])"), w, F.lit("(?![\\p{L}\\p{N}])"))
    return F.aggregate(names, text, lambda acc, f: F.regexp_replace(acc, alone(f["word"]), part_surrogate(f["part"], redrawn, key)))


def surrogate(v: Column, redrawn: Column, key: str = KEY) -> Column:
    """What an entity's writing v is replaced by."""
    plain = lambda kind: let(normal_form(kind, v), lambda norm: let(drawn(kind, norm, lookup(redrawn, kind, norm), key), lambda new: written_like(v, kind, new)))
    part = lambda p: F.when(p["kind"] == "kept", p["norm"]).when(p["kind"] == "initial", same_classes(p["norm"], stream(key, p["kind"], p["norm"], F.lit(0)))).otherwise(part_surrogate(p, redrawn, key))
    name = lambda: F.concat_ws(" ", F.split(v, " ")[0], F.array_join(F.transform(name_parts(v), part), " "))
    half = lambda kind: let(normal_form(F.lit(kind), v), lambda norm: drawn(F.lit(kind), norm, lookup(redrawn, F.lit(kind), norm), key))
    address = lambda: F.concat_ws("@", F.substring_index(half("mailbox"), "@@", 1), half("host"))
    return let(kind_of(v), lambda kind: F.when(kind == "name", name()).when(kind == "email", address()).otherwise(plain(kind)))


def written_like(v: Column, kind: Column, new: Column) -> Column:
    """The surrogate's normal form new in the format of v."""
    spare = F.regexp_extract(v, "^(.*?)(?:[0-9][^0-9]*){10}$", 1)  # country code
    phone = let(F.length(spare), lambda n: F.concat(F.substring(v, F.lit(1), n), lay_digits(F.substring(v, n + 1, F.length(v)), new)))
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(v, _SECRET_HEAD, 0), new, F.regexp_extract(v, _SECRET_TAIL, 0)))
        .when((kind == "phone") & new.startswith("+"), lay_digits(v, F.substring(new, F.lit(2), F.length(new))))
        .when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), lay_digits(v, new))
        .when(kind == "iban", F.when(v.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new))
        .otherwise(new)
    )


def entities(text: Column) -> Column:
    """All entities of the text in order. Without an @ there is no address to look for."""
    find = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains("@"), find(ENTITY)).otherwise(find(UNMAILED))


def between(text: Column) -> Column:
    """What lies before, between and after the entities."""
    return F.when(text.contains("@"), F.split(text, ENTITY, -1)).otherwise(F.split(text, UNMAILED, -1))


def normal_forms(found: DataFrame) -> DataFrame:
    """(kind, norm) of column v, one row for each part of a name, and for the mailbox and the host of an address."""
    kind, v = kind_of(F.col("v")), F.col("v")
    form = lambda k: F.struct(k.alias("kind"), normal_form(k, v).alias("norm"))
    parts = F.when(kind == "name", name_parts(v)).when(kind == "email", F.array(form(F.lit("mailbox")), form(F.lit("host")))).otherwise(F.array(form(kind)))
    return found.select("*", F.explode(parts).alias("p")).select(*found.columns, "p.*").drop("v").filter("kind not in ('kept', 'initial')")


def draws(forms: DataFrame, key: str = KEY, most: int = MOST_DRAWS) -> DataFrame:
    """(kind, norm, draw > 0) for those of all distinct forms that need another draw than the first."""
    state = cut(forms.distinct().withColumn("draw", F.lit(0)))
    for _ in range(most):
        made = state.withColumn("made", drawn(F.col("kind"), F.col("norm"), F.col("draw"), key))
        place = F.row_number().over(Window.partitionBy("kind", F.lower("made")).orderBy("draw", "norm"))
        real = state.select(F.col("kind").alias("k"), F.col("norm").alias("n"))
        again = made.withColumn("place", place).join(real, (F.col("kind") == F.col("k")) & (F.lower("made") == F.lower("n")), "left")
        again = cut(again.filter((F.col("place") > 1) | F.col("n").isNotNull()).select("kind", "norm").distinct())
        if again.limit(1).count() == 0:
            return state.filter("draw > 0")
        marked = state.join(again.withColumn("more", F.lit(1)), ["kind", "norm"], "left")
        state = cut(marked.select("kind", "norm", (F.col("draw") + F.coalesce("more", F.lit(0))).alias("draw")))
    raise RuntimeError(f"entities still share surrogates after {most} draws")


def replace_personal_data(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """docs with every entity of `text` replaced by its surrogate; with a column of their number if count names it."""
    found = docs.select(F.explode(entities(F.col("text"))).alias("v"))
    redrawn = draws(normal_forms(found.distinct()), key)
    none = F.create_map().cast("map<string,int>")
    held = docs.select(F.struct(*docs.columns).alias("row"), "text")  # names of docs' own can't clash then
    marked = held.withColumn("redrawn", none)
    if redrawn.limit(1).count():
        # Documents with such an entity, by text: few, as the clashes are.
        hit = docs.select(F.md5("text").alias("t"), F.explode(F.array_distinct(entities(F.col("text")))).alias("v"))
        by_text = normal_forms(hit).join(redrawn, ["kind", "norm"]).groupBy("t", "kind", "norm").agg(F.max("draw").alias("draw"))
        maps = cut(by_text.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "draw"))).alias("m")))
        maps = F.broadcast(maps) if maps.count() <= 10_000 else maps
        marked = held.withColumn("t", F.md5("text")).join(maps, "t", "left").select("row", "text", F.coalesce("m", none).alias("redrawn"))
    marked = marked.withColumn("found", entities(F.col("text")))
    new = F.transform("found", lambda v: surrogate(v, F.col("redrawn"), key))
    gaps = F.when(F.exists("found", lambda v: kind_of(v) == "name"), F.transform(between(F.col("text")), lambda a: bare_names_replaced(a, F.col("found"), F.col("redrawn"), key))).otherwise(between(F.col("text")))
    text = F.array_join(F.flatten(F.zip_with(gaps, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = marked.withColumn("text", F.when(F.size("found") > 0, text).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    counted = [F.coalesce(F.size("found"), F.lit(0)).alias(count)] if count else []
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns), *counted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")

"""Surrogates for personal data: keyed, type-consistent replacements, with DataFrame functions alone.

One scan detects entities (mail addresses, phone, card, bank and social-security numbers, IP addresses, secrets, names).
An entity is made of atoms: a mail address without its letter case, the digits of a number, a secret without the name it
stands after, a person's surname and given name apart. Each distinct atom gets one surrogate from a keyed digest, so
"Alice Smith" and "Mr Smith" share a surname, and "+1 555-123-4567" and "(555) 123-4567" a number. Letters stay letters
of their script and case, digits stay digits, punctuation stays; card and bank numbers stay valid, names keep gender and
script. A surrogate that is an atom of the corpus, or that another atom has, is drawn anew; after some draws surrogates
grow by a sign a draw, so no format runs out.
"""

from __future__ import annotations

import hashlib
from itertools import count as numbers

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import documents, drop_table, unused, write_table

#: Given names by script and gender: what marks a name, and what replaces it (fixed values).
GIVEN = {
    ("Latin", "f"): "Aisha Alice Amelia Anna Barbara Carmen Caroline Charlotte Claire Elena Elisabeth Elizabeth Emily Emma Eva Fatima Hannah Helen Isabel Jane Jennifer Julia Karen Laura Linda Lucia Margaret Maria Marie Mary Monica Nadia Olivia Patricia Paula Priya Rachel Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("Latin", "m"): "Adam Ahmed Albert Alexander Ali Andrew Antonio Benjamin Carlos Charles Christopher Daniel David Edward Fernando Francis Frank George Hans Henry Hugo James Javier John Joseph Juan Jürgen Karl Kevin Louis Luis Martin Michael Miguel Mohammed Oliver Patrick Paul Peter Philip Pierre Rahul Richard Robert Stefan Steven Thomas William".split(),
    ("Cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("Cyrillic", "m"): "Александр Андрей Дмитрий Иван Михаил Николай Сергей Юрий".split(),
    ("Greek", "f"): "Αικατερίνη Ελένη Ειρήνη Μαρία Σοφία".split(),
    ("Greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Νίκος Κώστας".split(),
}
#: Titles by gender; those of "" tell none (fixed values).
TITLES = {"f": "Mrs Ms Miss Frau Madame Señora".split(), "m": "Mr Herr Monsieur Señor".split(), "": "Dr Prof Doctor Professor".split()}
#: Syllables that surrogate surnames are made of, by script (fixed values).
SYLLABLES = {"Latin": "ba be bo da de do fa fe fi ga ge ka ke ki la le lo ma me mi na ne no ra re ri sa se so ta te".split() + ["to"], "Cyrillic": "ба во га да же за ка ла ма на по ра са та фа ша".split(), "Greek": "βα γε δα ζο θα κα λα μα νο πα ρα σα τα φα χα ψα".split()}

#: Endings of surrogate given names that no list holds, by script and gender (fixed values).
ENDINGS = {("Latin", "f"): "na", ("Latin", "m"): "n", ("Cyrillic", "f"): "на", ("Cyrillic", "m"): "н", ("Greek", "f"): "να", ("Greek", "m"): "νος"}
#: Country codes of one and of two digits in telephone numbers; all others have three (fixed values).
DIAL = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

EDGE, STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_names = "|".join(sorted((n for v in GIVEN.values() for n in v), key=lambda n: (-len(n), n)))
_titles = "|".join(sorted((t for v in TITLES.values() for t in v), key=lambda t: (-len(t), t)))
#: A capitalised word, also O'Neil and Lee-Ford; in a name an initial may stand between two.
_word = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)*+"
_after = rf"(?: \p{{Lu}}\.)? {_word}"
#: Names that a secret stands after, in any case; they may end a longer name, after an underscore.
SECRET_KEY = r"(?i:token|secret|password|passwd|api_key|apikey|access_key|private_key)\s{0,2}[:=]"
#: How known credentials start.
LEAD = r"AKIA|ghp_|sk-(?:proj-|ant-)?|eyJ"
#: Digits between blanks, of which cards are made; social-security and phone numbers are none.
_unit = r"[0-9]++(?:-[0-9]++)*+(?![\p{L}\p{N}_]|[.-][0-9])(?<!(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4})(?<!(?<![0-9])[0-9]{3}-[0-9]{3}-[0-9]{4})"
#: What each kind looks like; in a text the first kind that matches at a place wins. A card's pattern takes the whole run
#: of numbers that it may stand in; parts() cuts it out. Lengths are bounded only where the format itself has a bound.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\p{L}\p{N}:]))[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}_.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\p{L}\p{N}_]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}_.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])",
    "phone": r"(?<![\p{L}\p{N}_.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|(?<!-)0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -][0-9]{3,4})(?![\p{L}\p{N}_]|[.-][0-9])",
    "card": rf"(?<![\p{{L}}\p{{N}}_.+-])(?=[0-9](?:[ -]?[0-9]){{12}}){_unit}(?: {_unit})*+",
    "secret": rf"(?<![\p{{L}}\p{{N}}]){SECRET_KEY}\s{{0,2}}(?:\"[^\"\s]{{8,}}+(?=\")|'[^'\s]{{8,}}+(?=')|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_=-]{{12,}}(?:\.(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{{8,}}+)*+{STOP})",
    "credential": rf"{EDGE}(?:AKIA[0-9A-Z]{{16}}|ghp_[A-Za-z0-9]{{36}}|sk-(?:proj-|ant-)?(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{{20,}}+|eyJ[A-Za-z0-9_-]{{8,}}+\.eyJ[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+){STOP}",
    "iban": rf"{EDGE}[A-Z]{{2}}[0-9]{{2}}(?:(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?|[A-Z0-9]{{11,30}}){STOP}",
    "name": rf"{EDGE}(?:(?:{_titles})\.? {_word}(?:{_after})?|(?:{_names}){_after}){STOP}",
}
ENTITY = "|".join(f"(?:{x})" for x in KINDS.values())
#: What is the same on texts without any of FULL_MARKS: the kinds that need none, tried only where they can start.
FULL_MARKS = ("@", ":", "=", "ghp_", "sk-", "eyJ")
LIGHT = r"(?=[\p{Lu}0-9+(])(?:" + "|".join(f"(?:{x})" for k, x in KINDS.items() if k not in ("email", "ipv6", "secret")) + ")"
#: Draws of the same length, after which each draw is a sign longer.
SAME_LENGTH = 3


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for a valid card number."""
    reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(reverse, part), F.lit(0), lambda a, x: a + x)


def _is_card(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), _luhn(digits) % 10 == 0).otherwise(F.lit(False))


def _iban_rest(iban: Column) -> Column:
    """The remainder modulo 97 that is 1 for a valid bank account number."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    signs = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        n = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(signs, F.lit(0), step)


def parts(found: Column) -> Column:
    """What the patterns found, cut where it is a run of numbers: its cards, and what lies between them.

    A card is whole numbers in a row with 13 to 19 digits and a right check digit: from left to right, the longest first.
    Each number is marked with how many make up the card that starts there (0 for none), so one regular expression
    cuts runs of any length. What only looks like a bank number gives up its first word, and the rest is cut likewise.
    """

    def mark(numbers: Column) -> Column:
        def one(number: Column, i: Column) -> Column:
            card = lambda n: _is_card(_digits(F.array_join(F.slice(numbers, i + 1, n), "")))
            most = F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(numbers) - i)), card))
            return F.concat(F.lit("\x01"), F.substring(F.lit("0123456789abcdefghij"), F.coalesce(most, F.lit(0)) + 1, F.lit(1)), number)

        return F.array_join(F.transform(numbers, one), " ")

    number = r"\x01[0-9a-j][0-9-]++"
    card = "|".join(rf"\x01{c}[0-9-]++(?: {number}){{{n}}}" for n, c in enumerate("123456789abcdefghij"))
    run, bank = r"[0-9][0-9 -]{12,}", rf"\A(?:{KINDS['iban']})\z"

    def cut(numbers: Column) -> Column:
        marked = F.transform(F.array(F.split(numbers, " ")), mark)[0]
        pieces = F.regexp_extract_all(marked, F.lit(rf"{card}|(?: ?\x010[0-9-]++)++| "), F.lit(0))
        return F.transform(pieces, lambda c: F.regexp_replace(c, r"\x01.", ""))

    no_bank = found.rlike(bank) & (_iban_rest(found) != 1) & F.substr(found, F.lit(6)).rlike(rf"\A{run}\z")
    return F.when(found.rlike(rf"\A{run}\z"), cut(found)).when(no_bank, F.concat(F.array(F.substring(found, 1, 5)), cut(F.substr(found, F.lit(6))))).otherwise(F.array(found))


def entity_kind(entity: Column) -> Column:
    """The kind of a found entity, or null where its check digits say that it is none."""
    marks = {"secret": rf"\A{SECRET_KEY}", "credential": rf"\A(?:{LEAD})"}
    whole = F.coalesce(*[F.when(entity.rlike(marks.get(kind, rf"\A(?:{pattern})\z")), F.lit(kind)) for kind, pattern in KINDS.items()])
    wrong = ((whole == "card") & ~_is_card(_digits(entity))) | ((whole == "iban") & (_iban_rest(entity) != 1))
    return F.when(wrong, F.lit(None)).otherwise(whole)


def _by_text(text: str, use) -> Column:
    """use(pattern) with the pattern that the text needs."""
    marks = F.lit(False)
    for mark in FULL_MARKS:
        marks = marks | F.col(text).contains(mark)
    return F.when(marks, use(ENTITY)).otherwise(use(LIGHT))


# ---------------------------------------------------------------- atoms


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("Cyrillic")).when(text.rlike(r"\p{IsGreek}"), F.lit("Greek")).otherwise(F.lit("Latin"))


def _prefix(entity: Column) -> Column:
    """What stays of a secret or credential: the name it stands after, a quote, and how known credentials start."""
    return F.regexp_extract(entity, rf"\A(?:{SECRET_KEY}\s{{0,2}}[\"']?)?(?:(?:{LEAD})(?=.{{8}}))?", 0)


def _name_parts(entity: Column) -> dict[str, Column]:
    """title and initial with their blanks, given (of the lists or not) and surname; what a name lacks is empty."""
    title = F.regexp_extract(entity, rf"\A(?:{_titles})\.? ", 0)
    rest = F.substr(entity, F.length(title) + 1)
    words = F.split(rest, " ")
    first, one = words[0], F.size(words) == 1
    known = first.rlike(rf"\A(?:{_names})\z")
    given = F.when(~one | known, first).otherwise(F.lit(""))
    initial = F.when(F.size(words) > 2, words[1]).otherwise(F.lit(""))
    surname = F.when(one & known, F.lit("")).when(one, first).otherwise(F.element_at(words, -1))
    women = title.rlike("|".join(rf"\A{t}\.? " for t in TITLES["f"]))
    men = title.rlike("|".join(rf"\A{t}\.? " for t in TITLES["m"]))
    gender = F.when(women, F.lit("f")).when(men, F.lit("m")).otherwise(F.when(first.rlike("[aeiαа]$"), F.lit("f")).otherwise(F.lit("m")))
    return {"title": title, "given": given, "known": known, "initial": initial, "surname": surname, "gender": gender}


def atoms(entity: Column, kind: Column) -> Column:
    """array<struct<slot, atom_kind, atom>>: what an entity's surrogate is made of; slot 1 is an unlisted given name."""
    digits = _digits(entity)
    number = F.when(entity.startswith("+"), F.concat(F.lit("+"), digits)).when(digits.startswith("0"), digits).otherwise(F.concat(F.lit("+1"), digits))
    plain = (
        F.when(kind.isin("email", "ipv6"), F.lower(entity)).when(kind == "phone", number).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind.isin("secret", "credential"), F.substr(entity, F.length(_prefix(entity)) + 1)).otherwise(entity)
    )
    atom_kind = F.when(kind == "credential", F.lit("secret")).otherwise(kind)
    name = _name_parts(entity)
    one = lambda slot, k, a: F.struct(F.lit(slot).alias("slot"), k.alias("atom_kind"), a.alias("atom"))
    of_name = F.array(one(0, F.lit("surname"), name["surname"]), one(1, F.concat(F.lit("given-"), name["gender"]), F.when(name["known"], F.lit("")).otherwise(name["given"])))
    return F.when(kind == "name", F.filter(of_name, lambda a: a["atom"] != "")).otherwise(F.array(one(0, atom_kind, plain)))


# ---------------------------------------------------------------- surrogates


def _stream(key: str, what: Column, draw: Column) -> Column:
    """256 keyed digest bytes in hex."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(k)), draw.cast("string"), what), 512) for k in range(4)])


def _byte(stream: Column, i: Column) -> Column:
    """16 bits at place i, as an int."""
    return F.conv(F.substring(stream, (2 * (i % 254) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _swap(text: Column, stream: Column) -> Column:
    """Every digit, and every letter within its script and case, replaced; all else stays."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        at = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        latin, cyrillic, greek = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
        return (
            F.when(c.rlike("[0-9]"), at("0123456789"))
            .when(c.rlike("[a-zß-öø-ÿ]"), at(latin)).when(c.rlike("[A-ZÀ-ÖØ-Þ]"), at(latin.upper()))
            .when(c.rlike("[а-яё]"), at(cyrillic)).when(c.rlike("[А-ЯЁ]"), at(cyrillic.upper()))
            .when(c.rlike("[α-ωά-ώ]"), at(greek)).when(c.rlike("[Α-ΩΆ-Ώ]"), at(greek.upper()))
            .when(c.rlike(r"\p{L}"), at(latin)).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(words)), " "), (n % len(words) + 1).cast("int"))


def _more(stream: Column, letters: str, n: int) -> Column:
    """n signs more, of the far end of the stream."""
    if not n:
        return F.lit("")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(F.lit(letters), _byte(stream, F.lit(250) - 2 * k) % len(letters) + 1, F.lit(1))), "")


def with_surrogates(known: DataFrame, draw: int, key: str) -> DataFrame:
    """known (atom_kind, atom) -> the same and surrogate at a draw; from draw SAME_LENGTH on each is a sign longer."""
    more, atom, kind = max(0, draw - SAME_LENGTH + 1), F.col("atom"), F.col("atom_kind")
    stream, swapped, hexed = F.col("_stream"), F.col("_swapped"), F.col("_hexed")
    digits = F.concat(swapped, _more(stream, "0123456789", more))
    host = F.concat(_more(F.reverse(stream), "abcdefghijklmnopqrstuvwxyz", 6 + more), _pick([".example.com", ".example.org", ".example.net"], _byte(stream, F.lit(200))))
    body = F.concat(F.substring(atom, 1, 1), F.substr(swapped, F.lit(2), F.length(swapped) - 2), _more(stream, "0123456789", more))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    ip = F.concat_ws(".", (_byte(stream, F.lit(0)) % 223 + 1).cast("string"), *[(_byte(stream, F.lit(2 * k)) % 256).cast("string") for k in (1, 2)], (_byte(stream, F.lit(6)) % 254 + 1).cast("string"))
    ipv6 = hexed
    if more:  # addresses that run out get whole ones
        ip = ipv6 = F.concat(F.lit("fd"), F.substring(F.regexp_replace(stream, "(.{4})", "$1:"), 3, 37))
    country = F.regexp_extract(atom, rf"\A(?:\+(?:{DIAL}|[0-9]{{1,3}})|0)", 0)
    phone = F.concat(country, F.substr(digits, F.length(country) + 1))
    bank = F.concat(F.substring(atom, 1, 2), F.lit("00"), F.substr(swapped, F.lit(5)), _more(stream, "0123456789", more))
    bank = F.concat(F.substring(atom, 1, 2), F.lpad((98 - _iban_rest(bank)).cast("string"), 2, "0"), F.substr(bank, F.lit(5)))
    secret = F.when(atom.rlike(r"\A[0-9a-f]+\z"), hexed).when(atom.rlike(r"\A[0-9A-F]+\z"), F.upper(hexed)).otherwise(swapped)
    secret = F.concat(secret, _more(stream, "0123456789", more))
    script, surname, given = _script(atom), F.lit(""), F.lit("")
    for s, parts in SYLLABLES.items():
        made = lambda n, parts=parts: F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n + more - 1)), lambda k: _pick(parts, _byte(stream, 2 * k))), ""))
        surname = F.when(script == s, made(5)).otherwise(surname)
        given = F.when(script == s, F.concat(made(3), F.when(kind == "given-f", F.lit(ENDINGS[s, "f"])).otherwise(F.lit(ENDINGS[s, "m"])))).otherwise(given)
    out = (
        F.when(kind == "email", F.concat(F.substring_index(swapped, "@", 1), F.lit("@"), host))
        .when(kind == "card", card).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "phone", phone).when(kind == "iban", bank)
        .when(kind == "secret", secret).when(kind == "surname", surname).when(kind.startswith("given"), given).otherwise(digits)
    )
    streams = known.select("atom_kind", "atom", _stream(key, F.concat_ws("\x1f", kind, atom), F.lit(draw)).alias("_stream"))
    signs = F.filter(F.split(atom, ""), lambda c: c != "")
    hexes = F.transform(signs, lambda c, i: F.when(c.rlike("[0-9A-Fa-f]"), F.lower(F.hex((_byte(stream, i) % 16).cast("long")))).otherwise(c))
    return streams.withColumns({"_swapped": _swap(atom, stream), "_hexed": F.array_join(hexes, "")}).select("atom_kind", "atom", out.alias("surrogate"))


def given_names(key: str) -> dict[str, str]:
    """Each listed given name's surrogate: the next one of its script and gender, in an order that the key shuffles."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def _fill(entity: Column, signs: Column, kind: str) -> Column:
    """entity with its signs of a kind replaced in order; signs left over follow at the end."""
    pieces = F.regexp_extract_all(entity, F.lit(rf"[^{kind}]*+[{kind}]"), F.lit(0))
    filled = F.transform(pieces, lambda p, i: F.concat(F.substr(p, F.lit(1), F.length(p) - 1), F.substr(signs, i + 1, F.lit(1))))
    return F.concat(F.array_join(filled, ""), F.substr(signs, F.size(pieces) + 1))


def render(entity: Column, kind: Column, own: Column, given: Column, key: str) -> Column:
    """The entity's surrogate from those of its atoms: own (of slot 0) and given (of slot 1), null for what it lacks."""
    mailbox = F.transform(F.filter(F.split(F.substring_index(own, "@", 1), ""), lambda c: c != ""), lambda c, i: F.when(F.substr(entity, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    mail = F.concat(F.array_join(mailbox, ""), F.lit("@"), F.substring_index(own, "@", -1))
    mail = F.when(entity.rlike(r"\p{Ll}"), mail).when(entity.rlike(r"\p{Lu}"), F.upper(own)).otherwise(mail)
    dialled = F.when(entity.startswith("+"), F.substr(own, F.lit(2))).when(own.startswith("+1"), F.substr(own, F.lit(3))).otherwise(own)
    name, turn = _name_parts(entity), int(hashlib.sha256(key.encode()).hexdigest(), 16) % 25 + 1
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    listed = F.str_to_map(F.lit(" ".join(map(":".join, given_names(key).items()))), F.lit(" "), F.lit(":"))
    first = F.when(name["known"], listed[name["given"]]).otherwise(F.coalesce(given, F.lit("")))
    words = F.array(first, F.translate(name["initial"], letters, letters[turn:] + letters[:turn]), F.coalesce(own, F.lit("")))
    person = F.concat(name["title"], F.array_join(F.filter(words, lambda w: w != ""), " "))
    return (
        F.when(kind == "email", mail).when(kind == "phone", _fill(entity, dialled, "0-9")).when(kind.isin("card", "ssn"), _fill(entity, own, "0-9")).when(kind == "iban", _fill(entity, own, "A-Z0-9"))
        .when((kind == "ipv6") & entity.rlike("[A-F]"), F.upper(own)).when(kind.isin("secret", "credential"), F.concat(_prefix(entity), own)).when(kind == "name", person).otherwise(own)
    )


def draw_surrogates(known: DataFrame, key: str) -> DataFrame:
    """known (atom_kind, atom), distinct -> the same and surrogate.

    Draws go on until no surrogate is an atom of its kind or belongs to two; of two that collide the smaller atom keeps
    it. Every draw from SAME_LENGTH on multiplies what there is to draw from, so each atom gets one in the end.
    """
    done, left, total, columns = None, known, known.count(), ["atom_kind", "atom", "surrogate"]
    for draw in numbers():
        drawn = write_table(with_surrogates(left, draw, key), "pii-draws")
        free = drawn.join(known.select("atom_kind", F.col("atom").alias("surrogate")), ["atom_kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("atom_kind", "surrogate"), ["atom_kind", "surrogate"], "left_anti")
        winners = free.groupBy("atom_kind", "surrogate").agg(F.min("atom").alias("atom")).select(columns)
        before, done = done, write_table(winners if done is None else done.unionByName(winners), "pii-dictionary")
        for table in (drawn, before, left if draw else None):
            if table is not None:
                drop_table(table)
        if done.count() == total:
            return done
        left = write_table(known.join(done.select("atom_kind", "atom"), ["atom_kind", "atom"], "left_anti"), "pii-left")


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """entities (entity), any number of times each -> (entity, kind, surrogate), one row per distinct true entity."""
    found = write_table(entities.distinct().withColumn("kind", entity_kind(F.col("entity"))).where("kind IS NOT NULL"), "pii-entities")
    found_atoms = found.select("entity", "kind", F.explode_outer(atoms(F.col("entity"), F.col("kind"))).alias("a")).select("entity", "kind", "a.*")
    known = write_table(found_atoms.where("atom IS NOT NULL").select("atom_kind", "atom").distinct(), "pii-atoms")
    drawn = draw_surrogates(known, key)
    at = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("surrogate")))
    whole = found_atoms.join(drawn, ["atom_kind", "atom"], "left").groupBy("entity", "kind").agg(at(0).alias("_own"), at(1).alias("_given"))
    return whole.select("entity", "kind", render(F.col("entity"), F.col("kind"), F.col("_own"), F.col("_given"), key).alias("surrogate"))


# ---------------------------------------------------------------- the operator


def replace_pii(docs: DataFrame, key: str = "pagemill", count: str | None = None) -> DataFrame:
    """docs (text, ...) with every detected entity in text replaced; other columns as they are, one row per row.

    count names an added column with the number of replaced places. Null and empty texts, and texts without entities,
    stay as they are; texts are read whole, once: what is found is written beside them. Numbers that look like cards or
    bank accounts but fail their check digit are left alone; cards, phone and social-security numbers that stand beside
    other numbers are found; where two kinds match at one place the first of KINDS wins.
    Repeated rows get equal texts; an empty table gives an empty one; other columns may have any names. Texts with
    entities meet the surrogates by a hash of the text; hot texts and hot entities meet in joins whose sides adaptive
    execution splits.
    """
    columns, added, rest = docs.columns, [count] if count else [], [c for c in docs.columns if c != "text"]
    docs = docs.select(F.struct(*rest, F.lit(0).alias(unused("row", rest))).alias("_rest"), "text")  # names can't clash
    found = _by_text("text", lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    docs = docs.withColumn("_all", F.coalesce(found, F.array().cast("array<string>")))
    docs = write_table(docs.select("_rest", "text", F.transform("_all", parts).alias("_found")), "pii-found")
    hits = docs.where(F.size("_found") > 0).withColumn("_key", F.xxhash64("text"))
    pairs = write_table(hits.select("_key", F.explode(F.array_distinct(F.flatten("_found"))).alias("entity")).distinct(), "pii-pairs")
    known = dictionary(pairs.select("entity"), key)
    maps = pairs.join(known, "entity").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_map"))
    maps = write_table(maps, "pii-maps")
    none = F.create_map().cast("map<string,string>")
    hits = hits.join(maps, "_key", "left").withColumn("_map", F.coalesce("_map", none))
    new = F.transform("_found", lambda p: F.array_join(F.transform(p, lambda e: F.coalesce(F.element_at(F.col("_map"), e), e)), ""))
    new = F.concat(new, F.array(F.lit("")))
    text = F.array_join(F.zip_with(_by_text("text", lambda p: F.split("text", p, -1)), new, lambda a, b: F.concat(a, b)), "")
    places = F.size(F.filter(F.flatten("_found"), lambda e: F.map_contains_key(F.col("_map"), e))).cast("long")
    hits = hits.select("_rest", text.alias("text"), *[places.alias(name) for name in added])
    clean = docs.where(F.size("_found") == 0).select("_rest", "text", *[F.lit(0).cast("long").alias(name) for name in added])
    return hits.unionByName(clean).select(*[F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in columns], *added)


def query(spark, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir).select("doc_id", "text"), count="n_replaced")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in the place of personal data, one row per row; n_chars follows the text.

    Null and empty texts stay; long texts are read whole; repeated rows stay repeated; extra columns of any name pass
    through; an empty table gives an empty one.
    """
    out = replace_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out

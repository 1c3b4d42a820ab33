"""PII surrogates, with DataFrame functions only.

Mentions are found by one pattern, in one pass over the text; a mention's type and canonical form name its entity, so
differently written mentions of one entity (phone separators and country code, upper case) corefer. Every distinct
entity gets one surrogate: a keyed SHA-256 drives a type-consistent form (a valid address, number or check digit, the
same length, letters of the same script, a name of the same gender). Surrogates are checked over the whole corpus: one
that equals another surrogate or any real entity is drawn again, until all are distinct; after a few rounds drawn forms
get longer, so that no space runs out. Mentions are rendered in their own format (separators, country code, title, case).

Names are entities by part: "Mr. John F. Smith" is a first name (with the title's gender), an initial and a family name,
so "Mr. Smith" and, in the same document, "John Smith" or "Smith" without a title get the same parts. At the start of a
sentence a part that the corpus also has as an ordinary word ("Young") is replaced only beside another part.

Phone numbers with different country codes are different entities; one without a code is that of the only code that the
corpus has the number with.

Types: email, phone (its country code stays), ssn, ip (octets up to 255), ip6, card (15 or 16 digits that pass the Luhn
check), iban (check number 97), key (AKIA.., gh._.., sk-..), secret (hex of 32 digits or more, or the value after "password="
and the like: up to its closing quote, or of any length up to a blank but for points and commas at its end; after a
colon, see ``_STRONG``), name (with a title). A named value's mention
includes the name, which stays; the value is of its own type if it has one.

Only rows with a mention take part in joins; all others pass as they are. Edge cases: null and empty texts pass
unchanged; repeated rows are treated alike; a null id is an id of its own; numbers that fail their check stay; other
columns are kept, whatever their names.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_counted
from ..session import stage
from .common import read, row_key, whole_row

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TITLE = r"(?:(?:(?:M(?:rs?|s|iss|me|RS?|S)|H(?:err|ERR)|F(?:rau|RAU)|S(?:ra?|RA)|D(?:ra?|R)|P(?:rof|ROF)|г-(?:н|жа))\.?|M\.) )+"
_WOMAN = r"^(?:(?:Dr|DR|Prof|PROF)\.? )*(?:M(?:rs|s|iss|me|RS|S)|F(?:rau|RAU)|S(?:ra|RA)|Dra|г-жа)"
_WORD, _INITIAL = r"\p{Lu}[\p{L}'’-]+", r"\p{Lu}\."
_NAMED = r"(?i:password|passwd|pwd|secret|token|api_key|apikey)"
#: What stands before a named value, and the value: up to its closing quote, or without a quote up to a blank. After a
#: colon an unquoted value has a digit or sign or mixed case, or ends its line: else it is prose.
_BEFORE = rf"{_NAMED} ?[=:] ?[\"']?"
_VALUE = r"[^\s\"']*[^\s\"'.,;]"
_QUOTED = rf"{_NAMED} ?[=:] ?(?:\"[^\"\n]+(?=\")|'[^'\n]+(?='))"
_STRONG = r"(?=[\"']?\S*(?:[0-9#$%&*+/=@^_~|]|\p{Ll}\p{Lu})|[\"']?\S+[ \t]*(?:\n|\z))"
_UNQUOTED = rf"{_NAMED} ?(?:=|:(?= ?{_STRONG})) ?[\"']?{_VALUE}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){1,8}",
    "phone": r"(?<![0-9\p{L}+])\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,8}){1,3}(?![0-9])|(?<![0-9\p{L}+.,/-])0[1-9][0-9]{1,4}[ /-][0-9]{4,9}(?![0-9\p{L}]|[.,/-][0-9])|(?<![0-9\p{L}.-])1[.-][0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9\p{L}+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9\p{L}(])\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9\p{L}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9\p{L}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9\p{{L}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9\p{{L}}]|\.[0-9])",
    "ip6": r"(?<![0-9\p{L}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9\p{L}:])",
    "card": r"(?<![0-9\p{L}])(?:[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4}|3[47][0-9]{2}(?:[0-9]{11}|[ -][0-9]{6}[ -][0-9]{5}))(?![0-9\p{L}])",
    "iban": r"(?<![0-9\p{L}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9\p{L}])",
    "key": r"(?<![0-9\p{L}])(?:AKIA[0-9A-Z]{16}|gh[a-z]_[0-9A-Za-z]{20,}+|sk[-_](?:[a-z]{2,8}[-_])?[0-9A-Za-z]{16,}+)(?![0-9\p{L}])",
    "secret": r"(?<![0-9\p{L}])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![0-9\p{L}])",
    "name": rf"(?<!\p{{L}}){_TITLE}(?:(?:{_WORD}|{_INITIAL}) )*{_WORD}",
}
#: The last is for a value whose name is the end of another mention.
PATTERN = "|".join([_QUOTED, _UNQUOTED, *PATTERNS.values(), rf"(?<={_NAMED} ?= ?[\"']?){_VALUE}", rf"(?<={_NAMED} ?: ?[\"']?){_STRONG}{_VALUE}"])
#: Noncharacters that are put around mentions.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
#: Country codes of one and two digits (fixed values); all others have three.
_COUNTRY = r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_SCRIPTS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[0-9]": "0123456789",
    r"(?=\p{IsLatin})\p{Ll}": "àáâäçèéêëíîïñóôöùúûü",
    r"(?=\p{IsLatin})\p{Lu}": "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ",
    r"(?=\p{IsCyrillic})\p{Ll}": "абвгдежзиклмнопрстуфхцчшыэюя",
    r"(?=\p{IsCyrillic})\p{Lu}": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЫЭЮЯ",
    r"(?=\p{IsGreek})\p{L}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsHan}": "安白成大方高海江金林明南平青山石天文小新",
    r"(?=\p{IsArabic})\p{L}": "ابتجحدرزسشصطعفقكلمنهوي",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"(?=\p{IsDevanagari})\p{L}": "अआइउएकखगचजटडतदनपबमयरलवसह",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보",
    # Of any other script.
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{N}": "0123456789",
}
#: Syllables of made-up names: (beginnings, middles, endings by role: f and m first names, s family names, t and u those of women and men).
_NAMES = {
    "latin": (["ba", "do", "fe", "ga", "ka", "le", "mi", "no", "pe", "ra", "sa", "te", "vi", "wa", "ze", "lu"], ["bri", "dan", "lor", "mar", "nel", "ris", "son", "tor", "ven", "lin", "gar", "kel", "min", "pol", "ren", "sta"], {"f": ["a", "ia", "ina", "ela"], "m": ["o", "us", "an", "ert"], "s": ["er", "ley", "mann", "ford"]}),
    "cyrillic": (["ба", "до", "ве", "га", "ка", "ле", "ми", "но", "пе", "ра", "са", "те", "ви", "за", "лу", "фе"], ["бри", "дан", "лор", "мар", "нел", "рис", "сон", "тор", "вен", "лин", "гар", "кел", "мин", "пол", "рен", "ста"], {"f": ["а", "ия", "ина", "ела"], "m": ["ей", "ан", "он", "ир"], "t": ["ова", "ина", "ева", "ская"], "u": ["ов", "ин", "ев", "ский"]}),
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _number(h: Column, i: Column | int) -> Column:
    """Two hex digits of the stream ``h`` (64 of them, taken round and round) as a number."""
    at = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(F.concat(h, h), F.pmod(at * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _alike(text: Column, h: Column) -> Column:
    """Each letter and digit replaced by one of the same script, case and kind (a Latin one for rare scripts); other characters stay."""

    def one(ch, i):
        # Each round of 32 characters shifts the stream, so that long texts don't repeat themselves.
        n = _number(h, i) + F.floor(i / 32).cast("int") * 7
        out = ch
        for pattern, alphabet in reversed(_SCRIPTS.items()):
            out = F.when(ch.rlike(pattern), _pick(alphabet, n)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum: from the right, every second digit counts double."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _random_digits(h: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick("0123456789", _number(h, i))), "")


def _card(canon: Column, h: Column) -> Column:
    """The same length and issuer's digits, a valid check digit."""
    head = F.when(F.length(canon) == 15, F.substring(canon, 1, 2)).otherwise(F.substring(canon, 1, 1))
    body = F.concat(head, _random_digits(h, F.length(canon) - 1 - F.length(head)))
    return F.concat(body, F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))


def _mod97(iban: Column) -> Column:
    """Remainder of an IBAN (upper case, no blanks): its first four characters go to the end, letters count from 10."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _iban(canon: Column, h: Column) -> Column:
    country, account = F.substring(canon, 1, 2), _alike(F.substring(canon, 5, 64), h)
    check = 98 - _mod97(F.concat(country, F.lit("00"), account))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)


def _phone(canon: Column, h: Column) -> Column:
    """National digits: areas and exchanges start with 2 to 9."""
    n = F.length(canon)
    digit = lambda i: F.when((i == 0) | ((i == 3) & (n == 10)), _pick("23456789", _number(h, i))).otherwise(_pick("0123456789", _number(h, i)))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), digit), "")


def _ssn(h: Column) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001."""
    n = lambda at, k: F.conv(F.substring(h, at, 8), 16, 10).cast("long") % k + 1
    area = n(1, 898)
    area = area + F.when(area >= 666, 1).otherwise(0)
    return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lpad(n(9, 99).cast("string"), 2, "0"), F.lpad(n(17, 9999).cast("string"), 4, "0"))


def _made_name(canon: Column, h: Column, more: int = 0) -> Column:
    """``role:word`` -> a made-up word of the same script with the ending of the role; ``more`` syllables than usual."""
    role, w, longer = F.substring(canon, 1, 1), F.substring(canon, 3, 1 << 20), F.sha2(h, 256)
    some = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), F.pmod(n, F.lit(len(xs))) + 1)

    def of(script):
        begin, middle, ends = _NAMES[script]
        further = [some(middle, _number(longer, k)) for k in range(more)]
        end = F.lit("")
        for r, xs in ends.items():
            end = F.when(role == r, some(xs, _number(h, 3))).otherwise(end)
        return F.concat(some(begin, _number(h, 0)), some(middle, _number(h, 1)), some(middle, _number(h, 2)), *further, end)

    other = F.concat(_alike(w, h), _alike(F.repeat(F.substring(w, 1, 1), F.lit(more)), longer) if more else F.lit(""))
    return F.initcap(F.when(w.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(w.rlike(r"\p{IsLatin}"), of("latin")).otherwise(other))


def _value(m: Column) -> Column:
    return F.regexp_replace(m, f"^{_BEFORE}(?=.)", "")


def entity_type(m: Column) -> Column:
    """Type of a mention; null for a number that fails its check and has no name before it."""
    named, m = m.rlike("^" + _BEFORE), _value(m)
    out = F.lit("secret")
    for t in ("name", "key", "card", "iban", "ip6", "ip", "ssn", "phone", "email"):
        out = F.when(m.rlike("^(?:" + PATTERNS[t] + ")$"), F.lit(t)).otherwise(out)
    bad = ((out == "card") & (_luhn_sum(_digits(m)) % 10 != 0)) | ((out == "iban") & (_mod97(F.replace(m, F.lit(" "), F.lit(""))) != 1))
    return F.when(bad, F.when(named, F.lit("secret"))).otherwise(out)


def canonical(kind: Column, m: Column) -> Column:
    """Canonical form of a mention (of a name: see ``name_parts``)."""
    m = _value(m)
    # A phone number: country (if it is written) and number, without trunk zeros.
    digits, far = _digits(m), m.startswith("+")
    local = F.when(m.rlike("^1[.-]"), F.substring(digits, 2, 64)).otherwise(digits)
    number = F.regexp_replace(F.when(far, F.regexp_replace(digits, _COUNTRY, "")).otherwise(local), "^0+(?=.)", "")
    country = F.when(far, F.concat(F.regexp_extract(digits, _COUNTRY, 1), F.lit("|"))).when(m.rlike("^1[.-]"), F.lit("1|")).otherwise(F.lit(""))
    national = F.concat(country, number)
    return (
        F.when(kind.isin("card", "ssn"), _digits(m))
        .when(kind == "phone", national)
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ip6"), F.lower(m))
        .when((kind == "secret") & m.rlike("^[0-9A-Fa-f]+$"), F.lower(m))
        .otherwise(m)
    )


def name_parts(m: Column) -> Column:
    """Canonical parts ``role:word`` of a name with its title: first names by gender, initials, and the last word as family name."""
    m = _value(m)
    words = F.split(F.lower(F.regexp_replace(m, "^" + _TITLE, "")), " ")
    female = m.rlike(_WOMAN)
    last = F.element_at(words, -1)
    family = F.concat(F.when(last.rlike(r"\p{IsCyrillic}"), F.when(female, F.lit("t:")).otherwise(F.lit("u:"))).otherwise(F.lit("s:")), last)
    first = lambda w: F.concat(F.when(w.endswith("."), F.lit("i:")).when(female, F.lit("f:")).otherwise(F.lit("m:")), w)
    return F.concat(F.transform(F.slice(words, 1, F.size(words) - 1), first), F.array(family))


def _initial(canon: Column, key: str) -> Column:
    """``i:j.`` -> another initial, by a keyed turn of the alphabet, so that initials stay distinct."""
    turn = F.pmod(_number(F.sha2(F.lit(key + "\x1finitials"), 256), 0), F.lit(25)) + 1
    letter = F.ascii(F.substring(canon, 3, 1)) - 97
    return F.when(canon.rlike("^i:[a-z]"), F.concat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(letter + turn, F.lit(26)) + 1, F.lit(1)), F.lit("."))).otherwise(F.upper(F.substring(canon, 3, 8)))


#: From this attempt on surrogates are longer, by a syllable, a digit or two characters more each time.
LONGER = 4


def surrogate(kind: Column, canon: Column, key: str, attempt: int) -> Column:
    """The canonical surrogate that this attempt gives."""
    more = max(0, attempt - LONGER + 1)
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt))), 256)
    domain = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.element_at(F.split(canon, "@"), -1)), 256)
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(h, i) % F.when(i == 0, 223).otherwise(254) + 1).cast("string"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(canon) - 1) / 64).cast("int")), lambda i: F.when(i == 0, h).otherwise(F.sha2(F.concat(h, i.cast("string")), 256)))
    hexa = F.substring(F.array_join(blocks, ""), F.lit(1), F.length(canon))
    tail = F.substring(F.sha2(F.concat(h, F.lit("+")), 256), 1, 2 * more)
    number = F.substring_index(canon, "|", -1)  # of a phone, without its country
    prefix = F.regexp_extract(canon, "^(?:AKIA|gh[a-z]_|sk[-_](?:[a-z]{2,8}[-_])?)", 0)
    hex_like = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick("123456789abcdef", _number(h, i))).otherwise(c)), "")
    port = F.concat(F.lit(":"), (F.conv(F.substring(tail, 1, 4), 16, 10).cast("int") + 1).cast("string")) if more else F.lit("")
    return (
        F.when(kind == "email", F.concat(_alike(F.element_at(F.split(canon, "@"), 1), h), F.lit("-" if more else ""), tail, F.lit("@h"), F.substring(domain, 1, 8), F.lit(".example.net")))
        .when(kind == "ip", F.concat(F.array_join(octets, "."), port))
        .when(kind == "card", _card(canon, h))
        .when(kind == "iban", _iban(canon, h))
        .when(kind == "ip6", F.concat(hex_like, port))
        .when(kind == "phone", F.concat(_phone(number, h), _random_digits(F.sha2(h, 256), F.lit(more)) if more else F.lit("")))
        .when(kind == "ssn", F.concat(_ssn(h), _random_digits(F.sha2(h, 256), F.lit(more)) if more else F.lit("")))
        .when(kind == "key", F.concat(prefix, _alike(F.substring(canon, F.length(prefix) + 1, F.length(canon)), h)))
        .when(kind == "name", _made_name(canon, h, more))
        .when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), F.concat(hexa, tail))
        .when(kind == "secret", F.concat(_alike(canon, h), tail))
        .otherwise(F.concat(_alike(canon, h), _alike(F.lit("0" * more), F.sha2(h, 256)) if more else F.lit("")))
    )


def render(kind: Column, m: Column, s: Column) -> Column:
    """The surrogate in the format of the mention (of a name: see ``render_name``)."""
    whole, m = m, _value(m)
    before = F.substring(whole, F.lit(1), F.length(whole) - F.length(m))
    kept = F.when(kind == "iban", "[^0-9A-Z]").otherwise("[^0-9]")  # what stays as it is
    plain = lambda x: F.regexp_replace(x, kept, F.lit(""))
    own = F.length(F.substring_index(canonical(kind, whole), "|", -1))
    surplus = F.length(plain(m)) - own  # a country code and trunk zeros stay

    def one(ch, i):
        at = F.length(plain(F.substring(m, F.lit(1), i))) - surplus
        return F.when((F.length(plain(ch)) > 0) & (at >= 0), F.substring(s, at + 1, F.lit(1))).otherwise(ch)

    loud = (m == F.upper(m)) & (m != F.lower(m))
    new = F.when(kind.isin("phone", "ssn", "card", "iban"), F.concat(F.array_join(F.transform(F.split(m, ""), one), ""), F.substring(s, own + 1, F.length(s)))).otherwise(F.when(loud & (kind != "key"), F.upper(s)).otherwise(s))
    return F.concat(before, new)


def render_name(m: Column, parts: Column) -> Column:
    """Title, then the parts' surrogates in the case of the mention."""
    whole, m = m, _value(m)
    before = F.substring(whole, F.lit(1), F.length(whole) - F.length(m))
    words = F.array_join(parts, " ")
    return F.concat(before, F.regexp_extract(m, "^" + _TITLE, 0), F.when(m == F.upper(m), F.upper(words)).otherwise(words))


def assign(entities: DataFrame, key: str, max_attempts: int = 64) -> DataFrame:
    """``(kind, canon, surrogate)`` for every distinct entity ``(kind, canon)``: distinct surrogates, none a real entity.

    Each round draws for the entities that are left; of several that draw the same, the first keeps it.
    """
    pending, given = stage(entities, "entities"), None
    is_name = F.col("kind") == "name"
    every = pending.select("kind", F.when(is_name, F.substring("canon", 3, 1 << 20)).when(F.col("kind") == "phone", F.substring_index("canon", "|", -1)).otherwise(F.col("canon")).alias("_real")).distinct()
    like_real = F.when(is_name, F.lower("surrogate")).otherwise(F.col("surrogate")).alias("_real")
    for attempt in range(max_attempts):
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), key, attempt))
        if given is not None:
            drawn = drawn.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        drawn = drawn.select("*", like_real).join(every, ["kind", "_real"], "left_anti")
        won = stage(drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"), "surrogates")
        given = won if given is None else given.unionByName(won)
        pending = stage(pending.join(won, ["kind", "canon"], "left_anti"), "entities")
        if pending.isEmpty():
            return given
    raise RuntimeError(f"no distinct surrogates in {max_attempts} attempts")


def _maybe(text: Column) -> Column:
    """Cheap and wider than the pattern: a text without this has no mention."""
    named = (text.contains("=") | text.contains(":")) & text.rlike(rf"{_NAMED} ?[=:]")
    return text.rlike("[0-9@]") | text.rlike("AKIA|gh[a-z]_|sk[-_]") | named | text.rlike(rf"{_TITLE}\p{{Lu}}")


def _parts(text: Column) -> Column:
    """Text and mentions by turns, from one pass over the text (two where it has the marks itself)."""
    one = F.split(F.regexp_replace(text, PATTERN, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    two = F.flatten(F.zip_with(F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda p, m: F.array(p, F.coalesce(m, F.lit("")))))
    return F.when(text.contains(_OPEN) | text.contains(_CLOSE), two).otherwise(one)


def replace(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; with ``count_col``, also the number of distinct mentions replaced in the row.

    The key is that of the session's ``spark.eocube.pii.key`` unless one is given; without either it is a known one, for tests.
    """
    key = key if key is not None else docs.sparkSession.conf.get("spark.eocube.pii.key", "eocube")
    if count_col and count_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {count_col}")
    text = F.col(f"`{text_col}`")
    seen = docs.select(whole_row(docs), *row_key(id_col, text_col), F.when(_maybe(text), _parts(text)).alias("_parts"))
    # Texts stand in _parts or in _row.
    slim = F.col("_row").withField(f"`{text_col}`", F.when(F.col("_parts").isNull(), F.col("_row").getField(text_col)))
    seen = stage(seen.select(slim.alias("_row"), "_k1", "_k2", "_parts"), "pii-parts")
    marks = F.array_distinct(F.filter("_parts", lambda p, i: (i % 2 == 1) & (p != "")))
    found = stage(seen.filter("size(_parts) > 1").select("_k1", "_k2", F.explode(marks).alias("m")).distinct(), "mentions")

    kinds = stage(found.groupBy("m").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", entity_type(F.col("m"))).filter("kind is not null"), "kinds")
    canons = F.when(F.col("kind") == "name", name_parts(F.col("m"))).otherwise(F.array(canonical(F.col("kind"), F.col("m"))))
    named = kinds.select("m", "n", "kind", F.posexplode(canons).alias("pos", "canon"))
    # A number without a country is the one with it, if the corpus has it with one country only.
    country = F.substring_index("canon", "|", 1)
    abroad = named.filter("kind = 'phone' and contains(canon, '|')").groupBy(F.substring_index("canon", "|", -1).alias("canon"))
    only = abroad.agg(F.min(country).alias("_a"), F.max(country).alias("_b")).filter("_a = _b").select(F.lit("phone").alias("kind"), "canon", F.concat("_a", F.lit("|"), "canon").alias("_at"))
    named = stage(named.join(only, ["kind", "canon"], "left").select("m", "n", "kind", "pos", F.coalesce("_at", "canon").alias("canon")), "named")
    initial = F.col("canon").startswith("i:") & (F.col("kind") == "name")
    given = assign(named.filter(~initial).select("kind", "canon").distinct(), key)
    given = given.unionByName(named.filter(initial).select("kind", "canon", _initial(F.col("canon"), key).alias("surrogate")).distinct())
    own = named.join(given, ["kind", "canon"]).groupBy("m", "n", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))), lambda e: e["surrogate"]).alias("s"))
    words = F.split(F.regexp_replace(_value(F.col("m")), "^" + _TITLE, ""), " ")
    pairs = F.zip_with(words, "s", lambda w, x: F.struct(w.alias("w"), F.when(w == F.upper(w), F.upper(x)).otherwise(x).alias("s")))
    pairs = F.filter(pairs, lambda p: ~p["w"].endswith("."))  # not initials
    is_name = F.col("kind") == "name"
    rendered = stage(own.select("m", "n", F.when(is_name, render_name(F.col("m"), F.col("s"))).otherwise(render(F.col("kind"), F.col("m"), F.element_at("s", 1))).alias("s"), F.when(is_name, pairs).alias("w")), "rendered")

    per_row = join_counted(found, rendered, "m", found.count(), "n").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("m", "s")).alias("_e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("_w"))
    first = F.filter("_w", lambda e, i: (i == 0) | (F.get("_w", i - 1)["w"] != e["w"]))  # one surrogate by word
    maps = per_row.select("_k1", "_k2", F.map_from_entries("_e").alias("_map"), F.when(F.size("_w") > 0, F.map_from_entries(first)).alias("_words"))
    # Parts that are also ordinary words, as the corpus has them in lower case.
    parts = stage(named.filter(is_name & ~initial).select(F.substring("canon", 3, 1 << 20).alias("w")).distinct(), "name-parts")
    texts = seen.select(F.coalesce(F.array_join("_parts", ""), F.col("_row").getField(text_col)).alias("t"))
    if not parts.isEmpty():
        used = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?<![\p{L}'’-])\p{Ll}[\p{L}'’-]+"), F.lit(0)))).alias("w"))
        near = F.broadcast(parts) if parts.count() <= 50_000 else parts
        parts = stage(used.join(near, "w", "left_semi").distinct(), "ordinary-words")
    else:
        parts = parts.limit(0)
    ordinary = maps.filter("_words is not null").select("_k1", "_k2", F.explode(F.map_keys("_words")).alias("p")).join(parts, F.lower("p") == F.col("w"), "left_semi")
    maps = maps.join(ordinary.groupBy("_k1", "_k2").agg(F.collect_list("p").alias("_ordinary")), ["_k1", "_k2"], "left")
    touched = seen.filter("_parts is not null").join(maps, ["_k1", "_k2"], "left")

    def untitled(p):
        """Parts without a title; at the start of a sentence an ordinary word counts only beside another part."""
        t = F.split(p, r"(?<=[^\p{L}'’-])|(?=[^\p{L}'’-])")
        at = lambda i: F.element_at("_words", F.when((i >= 0) & (i < F.size(t)), F.get(t, i)))

        def one(w, i):
            starts = (i == 0) | F.concat(F.coalesce(F.get(t, i - 2), F.lit(".")), F.coalesce(F.get(t, i - 1), F.lit(" "))).rlike(r"[.!?:;\n\"“„»(]\s*$|\n$")
            alone = at(i - 2).isNull() & at(i + 2).isNull()
            keep = starts & alone & F.coalesce(F.array_contains("_ordinary", w), F.lit(False))
            return F.when(keep, w).otherwise(F.coalesce(F.element_at("_words", w), w))

        return F.array_join(F.transform(t, one), "")

    def changed(p, i):
        return F.when(i % 2 == 1, F.coalesce(F.element_at("_map", p), p)).when(F.col("_words").isNotNull(), untitled(p)).otherwise(p)

    new = F.array_join(F.when(F.col("_map").isNull(), F.col("_parts")).otherwise(F.transform("_parts", changed)), "")
    both = touched.select("_row", new.alias("_new"), F.coalesce(F.size("_map"), F.lit(0)).alias("_n")).unionByName(seen.filter("_parts is null").select("_row", F.col("_row").getField(text_col).alias("_new"), F.lit(0).alias("_n")))
    out = [F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return both.select(*out, *([F.col("_n").cast("long").alias(count_col)] if count_col else []))


def op6_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, count_col="n_entities")

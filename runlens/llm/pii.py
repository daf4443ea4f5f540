"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A surrogate is a function of the key and the entity's canonical form, so an entity has the same surrogate in every
document. The words of a name are entities of their own, so that Mr. Smith and John Smith share a surname afterwards,
too. A check over all different entities finds surrogates that two of them share, or that are themselves an entity of
the corpus; such entities are drawn again until none is left, and only those redrawn are looked up. Later draws are
longer, so that this ends however few surrogates a format has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ids_and_texts, small_enough, worker_cache

#: The setting that names the secret key of op4_pii, and the key of that query alone where it isn't set: its surrogates
#: can be guessed, so it is for synthetic tables.
KEY_SETTING, TRIAL_KEY = "spark.runlens.pii.key", "trial"
#: From this attempt on, formats of fixed length get further characters.
WIDER_FROM = 6
#: Documents with redrawn entities up to which their table is broadcast; more are joined by a shuffle.
MAX_BROADCAST_DOCS = 200_000

ENTITIES = "doc_id long, sign long, kind string, canonical string"
RESULT = "doc_id long, text string, n_entities long, kinds array<string>"

#: Titles before a name, and given names, by gender; the scripts that surnames are composed for.
TITLES = {"m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа"], "n": ["Dr", "Prof", "Mx", "Доктор"]}
GIVEN = {
    ("latin", "m"): ["James", "John", "Robert", "Michael", "David", "William", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Karl", "Jean", "Pierre", "Carlos", "Juan", "Luis", "Miguel"],
    ("latin", "f"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Emma", "Julia", "Claudia", "Marie", "Sophie", "Carmen", "Lucia", "Elena", "Rosa"],
    ("latin", "n"): ["Alex", "Robin", "Sam", "Kim", "Jordan", "Taylor", "Charlie", "Dominique"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"],
    ("cyrillic", "f"): ["Мария", "Анна", "Ольга", "Елена", "Наталья", "Ирина"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя"],
}
SYLLABLES = {"latin": ["ba", "den", "ler", "mon", "tis", "ka", "rov", "sel", "win", "dor", "han", "per", "lo", "mar", "stein", "ton"], "cyrillic": ["ба", "ден", "лер", "мон", "тис", "ка", "ров", "сел", "вин", "дор", "хан", "пер"]}
ENDINGS = {("latin", "m"): ["us", "o", "ek"], ("latin", "f"): ["a", "ia", "ina"], ("latin", "n"): ["y", "i"], ("cyrillic", "m"): ["ий", "ей"], ("cyrillic", "f"): ["а", "ия"], ("cyrillic", "n"): ["я", "ю"]}


def pattern() -> Any:
    """One expression; the name of the group that matched is the kind of entity."""
    import regex

    titles = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
    given = "|".join(sorted({n for (_, g), ns in GIVEN.items() if g != "n" for n in ns}, key=len, reverse=True))
    return regex.compile(
        r"(?P<email>(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.)+\p{L}{2,24}\b)"
        r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,80}\b)"
        r"|(?:\b(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9_+/.~-]{8,128})"
        r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
        r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
        r"|(?P<card>(?<![\w.-])[2-6](?:\d{12,18}|\d{3}(?:[ -]\d{4}){3})(?![\w-]))"
        r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
        r"|(?P<phone>(?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ -]?\(?\d{1,4}\)?){1,2}(?:[ -]?\d{2,4}){2,3}(?![\w.]))"
        r"|\b(?:" + titles + r")\.?\s(?P<titled>\p{Lu}[\p{Ll}'’]+(?:[ -]\p{Lu}[\p{Ll}'’]+){0,2})"
        r"|\b(?P<named>(?:" + given + r")(?: \p{Lu}[\p{Ll}'’]+){1,2})"
    )


def luhn_digit(digits: str) -> str:
    """The check digit behind the digits."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


#: Ranges of the leading digits of payment card numbers, and the lengths in use there.
CARD_RANGES = [("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("3528", "3589", (16,)), ("6011", "6011", (16,)), ("62", "62", (16, 17, 18, 19)), ("644", "659", (16,))]


def is_card_number(digits: str) -> bool:
    """Whether the leading digits and the length are in use; other numbers with a good check digit are no cards."""
    return any(low <= digits[: len(low)] <= high and len(digits) in lengths for low, high, lengths in CARD_RANGES)


class Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: str, kind: str, canonical: str, attempt: int = 0):
        import hashlib
        import hmac

        self.seed = hmac.new(key.encode(), f"{kind}\0{canonical}\0{attempt}".encode(), hashlib.sha256).digest()
        self.block, self.count = b"", 0

    def below(self, n: int) -> int:
        import hashlib

        if len(self.block) < 8:
            self.block += hashlib.sha256(self.seed + self.count.to_bytes(4, "big")).digest()
            self.count += 1
        value, self.block = int.from_bytes(self.block[:8], "big"), self.block[8:]
        return value % n

    def like(self, text: str) -> str:
        """Digits for digits and letters for letters of the same case and script; everything else as it is."""
        out = []
        for c in text:
            alphabet = alphabet_of(c)
            out.append(alphabet[self.below(len(alphabet))] if alphabet else c)
        return "".join(out)

    def longer(self, text: str, by: int) -> str:
        """like, with `by` further characters of the kind of the last letter or digit."""
        last = next((c for c in reversed(text) if alphabet_of(c)), "0")
        return self.like(text + last * by)


def alphabet_of(c: str) -> str:
    """The characters that a letter or digit may become, remembered by each worker."""
    known = worker_cache("pii-alphabets", dict)
    if c not in known:
        known[c] = _alphabet(c)
    return known[c]


def _alphabet(c: str) -> str:
    """The plain letters of a letter's script and case, else the letters of its category in its block of 128 code points
    (Han: 256); the digits of a digit's script; nothing for other characters."""
    import unicodedata

    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    for plain in ("abcdefghijklmnopqrstuvwxyz", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"):
        for letters in (plain, plain.upper()):
            if c in letters:
                return letters
    if not c.isalpha():
        return ""
    kind, width = unicodedata.category(c), 256 if 0x3400 <= ord(c) < 0xA000 else 128
    block = map(chr, range(ord(c) // width * width, ord(c) // width * width + width))
    # one character before and after changes of case, so that lengths and canonical forms stay
    return "".join(x for x in block if unicodedata.category(x) == kind and len(x.lower()) == len(x.upper()) == len(x.casefold()) == 1 and x.upper().lower() == x.lower()) or c


def script_of(text: str) -> str:
    """latin, cyrillic or other."""
    letters = [c for c in text if c.isalpha()]
    if any("Ѐ" <= c <= "ӿ" for c in letters):
        return "cyrillic"
    return "latin" if all(c <= "ɏ" or "Ḁ" <= c <= "ỿ" for c in letters) else "other"


def gender_of(kind: str, whole: str, name: str) -> str:
    """From the title before the name, else from the given name; n where neither tells."""
    first = whole[: len(whole) - len(name)].strip().rstrip(".") if kind == "titled" else ""
    for gender, titles in TITLES.items():
        if first in titles and gender != "n":
            return gender
    start = name.split()[0]
    return next((g for (_, g), names in GIVEN.items() if g != "n" and start in names), "n")


def canonical_of(kind: str, value: str) -> tuple[str, str]:
    """(type, canonical form): what makes two mentions other than names the same entity."""
    if kind == "email":
        return "email", value.lower()
    if kind == "phone":  # a leading 1 of eleven digits is a country code that may be left out
        digits = _digits(value)
        return kind, digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind in ("card", "ssn"):
        return kind, _digits(value)
    if kind == "iban":
        return kind, value.replace(" ", "")
    return kind, value


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdecimal())


def parts_of(kind: str, whole: str, value: str) -> list[tuple[str, str]]:
    """(type, canonical form) of the entities that a mention is made of: of a name its words, the last of them the
    surname and the others given names with the gender that title or first name tell; of all else one."""
    if kind not in ("titled", "named"):
        return [canonical_of(kind, value)]
    gender, words = gender_of(kind, whole, value), value.casefold().split()
    return [*(("given", f"{gender}:{w}") for w in words[:-1]), ("surname", words[-1])]


def surrogate_of(kind: str, canonical: str, key: str, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate. Every attempt is another draw; later ones are longer."""
    draw, more = Stream(key, kind, canonical, attempt), max(0, attempt - WIDER_FROM + 1)
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        site = Stream(key, "domain", domain)  # one domain stays one domain
        return f"{draw.longer(local, attempt if len(local) + attempt <= 64 else more)}@{'.'.join([*(site.like(x) for x in labels[:-1]), labels[-1]])}"
    if kind == "card":
        body = canonical[:4] + draw.longer(canonical[4:-1], more)
        return body + luhn_digit(body)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4 + more))
    if kind == "phone":
        keep = max(0, len(canonical) - 10)
        return canonical[:keep] + str(2 + draw.below(8)) + draw.longer(canonical[keep + 1 :], more)
    if kind == "iban":
        body = draw.longer(canonical[4:], more)
        number = int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00"))
        return f"{canonical[:2]}{98 - number % 97:02d}{body}"
    if kind == "key":
        keep = 4
        return canonical[:keep] + draw.longer(canonical[keep:], more)
    if kind == "secret":
        lower, upper = canonical.lower() == canonical, canonical.upper() == canonical
        if all(c in "0123456789abcdefABCDEF" for c in canonical) and (lower or upper):
            return "".join(("0123456789abcdef" if lower else "0123456789ABCDEF")[draw.below(16)] for _ in range(len(canonical) + more))
        return draw.longer(canonical, more)
    if kind == "given":
        gender, _, name = canonical.partition(":")
        script = script_of(name)
        if script == "other":
            return f"{gender}:{draw.longer(name, attempt)}"
        if not attempt:
            names = [n for n in GIVEN[(script, gender)] if n.casefold() != name]
            return f"{gender}:{names[draw.below(len(names))].casefold()}"
        return f"{gender}:{_syllables(draw, script, attempt + 1)}{ENDINGS[(script, gender)][draw.below(len(ENDINGS[(script, gender)]))]}"
    if kind == "surname":
        script = script_of(canonical)
        return draw.longer(canonical, attempt) if script == "other" else _syllables(draw, script, 2 + draw.below(2) + attempt)
    return draw.longer(canonical, more)


def _syllables(draw: Stream, script: str, n: int) -> str:
    parts = SYLLABLES[script]
    return "".join(parts[draw.below(len(parts))] for _ in range(n))


def dress(kind: str, value: str, surrogates: list[str]) -> str:
    """The parts' surrogates in the format of the mention: separators, blanks and letter case."""
    surrogate = surrogates[0]
    if kind in ("phone", "card", "ssn", "iban"):
        digits = _digits(value)
        if kind == "phone" and len(digits) == 11 and digits[0] == "1":
            surrogate = "1" + surrogate
        chars = iter(surrogate)
        return "".join(next(chars, "") if c.isalnum() else c for c in value) + "".join(chars)
    if kind == "email":
        return surrogate.upper() if value.isupper() else surrogate
    if kind in ("titled", "named"):
        words = [s.partition(":")[2] or s for s in surrogates]
        return " ".join(w.upper() if old.isupper() else w[:1].upper() + w[1:] for w, old in zip(words, value.split(), strict=True))
    return surrogate


def mentions(text: str, find: Callable[[str], Any]) -> Iterator[tuple[int, int, str, list[tuple[str, str]], str]]:
    """(start, end, kind, parts, text) of each mention."""
    for m in find(text):
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "card":
            digits = _digits(value)
            if luhn_digit(digits[:-1]) != str(int(digits[-1])) or not is_card_number(digits):
                continue
        if kind == "iban":
            account = value.replace(" ", "")
            if int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 != 1:
                continue
        yield m.start(kind), m.end(kind), kind, parts_of(kind, m.group(0), value), value


def _finder() -> Callable[[str], Any]:
    made = worker_cache("pii-pattern", pattern)
    can_hold = worker_cache("pii-screen", screen)
    return lambda text: made.finditer(text) if can_hold(text) else ()


def screen() -> Callable[[str], bool]:
    """Whether a text can hold any entity at all: cheap looks before the whole expression, each implied by the
    alternatives of the expression that it stands for."""
    import re

    names = {t for ts in TITLES.values() for t in ts} | {n for ns in GIVEN.values() for n in ns}
    numbers = re.compile(r"\d[\d ().-]{5}|[A-Z]{2}\d\d ?[A-Z0-9]{4}").search
    capitalised = re.compile(r"[A-ZА-ЯЁ]\w+").findall
    exact, folded = ("@", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("passw", "pwd", "token", "secret", "api")

    def look(text: str) -> bool:
        if any(x in text for x in exact) or numbers(text):
            return True
        low = text.lower() if text.isascii() else text.casefold()
        return any(x in low for x in folded) or not names.isdisjoint(capitalised(text))

    return look


def _detect(source: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa
    import xxhash

    find = _finder()
    schema = pa.schema([("doc_id", pa.int64()), ("sign", pa.int64()), ("kind", pa.string()), ("canonical", pa.string())])
    for batch in source:
        out: list[list[Any]] = [[], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {part for _, _, _, parts, _ in mentions(text, find) for part in parts}
            if found:
                sign = xxhash.xxh64_intdigest(text.encode(), 42)
                for kind, canonical in sorted(found):
                    for c, v in zip(out, (doc_id, sign - ((sign >> 63) << 64), kind, canonical), strict=True):
                        c.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _draw(key: str) -> Any:
    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in source:
            kinds, canonicals, attempts = (batch.column(i).to_pylist() for i in range(3))
            drawn = [surrogate_of(k, c, key, a) for k, c, a in zip(kinds, canonicals, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, type=pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    return run


def _replace(key: str) -> Any:
    def run(source: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        find = _finder()
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), ("kinds", pa.list_(pa.string()))])
        for batch in source:
            out: list[list[Any]] = [[], [], [], []]
            for doc_id, text, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                attempts = {(a["kind"], a["canonical"]): a["attempt"] for a in again or ()}
                pieces, at, n, kinds = [], 0, 0, set()
                for start, end, kind, parts, value in mentions(text, find):
                    pieces += [text[at:start], dress(kind, value, [surrogate_of(*p, key, attempts.get(p, 0)) for p in parts])]
                    at, n = end, n + 1
                    kinds.add("person" if kind in ("titled", "named") else kind)
                for c, v in zip(out, (doc_id, "".join([*pieces, text[at:]]) if n else text, n, sorted(kinds)), strict=True):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def settle(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canonical, attempt) of the entities that have to be drawn again, after which all surrogates differ.

    Of entities that share a surrogate the one with the smallest canonical form keeps it; an entity whose surrogate
    is an entity of the corpus is drawn again too, other than given names, of which all corpora hold the common ones.
    Rounds go on until none is left; as later draws are longer, that does not depend on how many there are of a kind.
    """
    current = entities.withColumn("attempt", F.lit(0))
    known = entities.where("kind <> 'given'").select("kind", F.col("canonical").alias("surrogate"))
    for i in count():
        drawn = scratch.write(current.mapInArrow(_draw(key), "kind string, canonical string, attempt int, surrogate string"), f"drawn{i}")
        shared = drawn.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("canonical").alias("first")).where("n > 1")
        real = drawn.join(known, ["kind", "surrogate"], "left_semi").select("kind", "canonical")
        clash = drawn.join(shared, ["kind", "surrogate"]).where(F.col("canonical") != F.col("first")).select("kind", "canonical")
        again = scratch.write(clash.unionByName(real).distinct().withColumn("bump", F.lit(1)), f"again{i}")
        if again.isEmpty():
            return drawn.where("attempt > 0").select("kind", "canonical", "attempt")
        current = drawn.join(again, ["kind", "canonical"], "left").select("kind", "canonical", (F.col("attempt") + F.coalesce("bump", F.lit(0))).cast("int").alias("attempt"))


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", max_broadcast_docs: int = MAX_BROADCAST_DOCS) -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_entities (mentions replaced), kinds.

    The key is a secret: who knows it can tell which surrogate an entity gets. Letters become letters of their own
    script, whichever it is. Names in scripts other than Latin and Cyrillic keep their length, not their gender.
    Where a format has too few surrogates for all entities (one-letter addresses, a corpus of all numbers), some are
    longer than their format. Names without a title or a listed given name are not found.

    Null text becomes the empty text. Null ids and repeated rows are worked on row by row, with the same surrogates
    for the same entities. Texts without entities come back unchanged. An empty table gives an empty result. Other
    columns are not read.
    """
    scratch = Scratch(df.sparkSession, "pii")
    docs = ids_and_texts(df, id_col, text_col)
    found = scratch.write(docs.mapInArrow(_detect, ENTITIES), "found")
    again = settle(scratch.write(found.select("kind", "canonical").distinct(), "entities"), key, scratch)
    per_doc = found.join(again, ["kind", "canonical"]).groupBy(F.col("doc_id").alias("again_id"), "sign").agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("again"))
    per_doc = scratch.write(per_doc, "per_doc")
    if small_enough(per_doc, max_broadcast_docs):
        per_doc = F.broadcast(per_doc)
    same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.xxhash64("text") == F.col("sign"))
    return docs.join(per_doc, same, "left").select("doc_id", "text", "again").mapInArrow(_replace(key), RESULT)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(KEY_SETTING, TRIAL_KEY))

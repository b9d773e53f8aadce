"""Personal information in free text replaced by typed placeholders or by keyed surrogates of the same kind.

A surrogate depends on the key and the entity only, so one person keeps one surrogate through the corpus
(coreference), and it is made by permutations, so two different entities never get the same one
(distinctness): digits, consonants and vowels are each encrypted within their own alphabet by a Feistel
cipher; initials move along one keyed cycle of letters, and every part of a name gets a part of its own that
begins with its letter's successor, made from keyed cycles of the lexicon's beginnings and endings.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morbiscope.llm.personal_entities import CONNECTORS, NameLexicon, Span, find_entities
from morbiscope.llm.tree_tokenizer import slices
from morbiscope.operators.checks import ContractError
from morbiscope.runtime import spread, written

PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "address": "[ADDRESS]"}
#: Rows of the list of name parts that the lexicon is fitted on (a bounded table; more rows are refused).
MAX_PARTS = 200_000

_ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz")
_WHERE = {c: (a, a.index(c)) for a in _ALPHABETS for c in a}
# Words of addresses and of e-mail addresses that say what the parts are, and stay.
_KEPT_WORDS = frozenset(
    "jl jln jalan kp kampung gg rt rw no blk block lot village subdivision subd homes purok brgy barangay house hse flat unit apt apartment room suite "
    "street st road rd avenue ave lane ln close drive crescent boulevard blvd terrace way po p o box lorong persiaran lebuh taman số đường phố phường xã "
    "quận huyện tổ ấp thôn khu rua avenida av travessa largo aldeia bairro casa n de da do das dos group หมู่ ที่ ถนน ถ ซอย ซ ตำบล ต อำเภอ อ at dot ext "
    "example test invalid com org net gov edu".split()
)


class Surrogates:
    """Replacements for entities under one key."""

    ROUNDS = 4

    def __init__(self, key: str, lexicon: NameLexicon):
        self.key, self.lexicon = key.encode(), lexicon
        self.cycles: dict[tuple[str, int], dict[str, str]] = {}
        for position, sides in lexicon.affixes.items():
            # A given name's ending marks its gender, so only its beginning moves; a family name moves whole.
            for side, members in enumerate(sides):
                order = list(members)
                random.Random(self._digest(f"{position}{side}".encode())).shuffle(order)
                fixed = position == "given" and side == 1
                self.cycles[position, side] = {m: m if fixed else order[(i + 1) % len(order)] for i, m in enumerate(order)}
        self.letters: dict[str, str] = {}
        for alphabet in _ALPHABETS[1:]:
            order = list(alphabet)
            random.Random(self._digest(f"initial/{alphabet}".encode())).shuffle(order)
            self.letters |= {m: order[(i + 1) % len(order)] for i, m in enumerate(order)}
        self.parts = self._parts()

    def _parts(self) -> dict[str, str]:
        """A surrogate of its own for every part of the lexicon, its first letter that of the part's initial."""
        made: dict[str, str] = {}
        taken = set(CONNECTORS)
        for word, (position, beginning, ending) in sorted(self.lexicon.split.items()):
            made[word] = next(x for x in self._candidates(word, position, beginning, ending) if x not in taken and x != word)
            taken.add(made[word])
        return made

    def _candidates(self, word: str, position: str, beginning: str, ending: str) -> Iterator[str]:
        """Surrogates of one part, the likeliest first: tails of other beginnings, then scrambled ones that get longer."""
        first = self.letters.get(word[:1], word[:1])
        if ending:
            cycle, last = self.cycles[position, 0], self.cycles[position, 1].get(ending, ending)
            at = beginning
            for _ in range(len(cycle)):
                at = cycle.get(at, at)
                if at[1:] != beginning[1:]:
                    yield first + at[1:] + last
        else:
            beginning, last = word, ""
        for n in count():
            yield first + self.scramble(beginning[1:] + "an" * (n // 20), f"part/{n}") + last

    def _digest(self, data: bytes) -> bytes:
        return hashlib.blake2b(data, key=self.key[:64], digest_size=16).digest()

    def permute(self, values: list[int], radix: int, tweak: str) -> list[int]:
        """A keyed bijection on sequences of ``len(values)`` digits of ``radix`` (unbalanced Feistel)."""
        n = len(values)
        if n == 0:
            return []
        if n == 1:
            order = list(range(radix))
            random.Random(self._digest(f"{tweak}/1/{radix}".encode())).shuffle(order)
            return [order[values[0]]]
        half = n // 2
        left, right = values[:half], values[half:]
        for r in range(self.ROUNDS):
            source, target = (right, left) if r % 2 == 0 else (left, right)
            pad = int.from_bytes(self._digest(f"{tweak}/{r}/{n}/{radix}/".encode() + bytes(source)), "big")
            mixed = []
            for v in target:
                pad, step = divmod(pad, radix)
                mixed.append((v + step) % radix)
                if pad == 0:
                    pad = int.from_bytes(self._digest(f"{tweak}/{r}/{len(mixed)}".encode() + bytes(source)), "big")
            left, right = (mixed, right) if r % 2 == 0 else (left, mixed)
        return left + right

    def scramble(self, text: str, tweak: str, keep: Iterable[tuple[int, int]] = ()) -> str:
        """``text`` with digits, vowels and consonants replaced within their kind; case and all else kept."""
        kept = set()
        for a, b in keep:
            kept.update(range(a, b))
        out = list(text)
        for alphabet in _ALPHABETS:
            at = [i for i, c in enumerate(text) if i not in kept and (hit := _WHERE.get(c.lower())) and hit[0] is alphabet]
            new = self.permute([_WHERE[text[i].lower()][1] for i in at], len(alphabet), f"{tweak}/{len(at)}")
            for i, v in zip(at, new):
                out[i] = alphabet[v].upper() if text[i].isupper() else alphabet[v]
        return "".join(out)

    def name_part(self, word: str) -> str:
        new = self.parts.get(word.lower()) or self.scramble(word.lower(), "part")
        return new.upper() if word.isupper() and len(word) > 1 else new.capitalize() if word[:1].isupper() else new

    def name(self, text: str) -> str:
        """Parts in their own order and case; an initial becomes that of the parts it may stand for."""

        def one(m: re.Match) -> str:
            word = m.group()
            if word.lower() in CONNECTORS:
                return word
            if len(word) == 1:
                new = self.letters.get(word.lower(), word)
                return new.upper() if word.isupper() else new
            return self.name_part(word)

        return re.sub(r"[^\W\d_]+", one, text)

    def replace(self, kind: str, text: str, known: dict[str, str] | None = None) -> str:
        """The surrogate of one entity; it is the same in every document, ``known`` is not read."""
        return self.name(text) if kind == "name" else self._other(kind, text)

    @lru_cache(maxsize=50_000)  # noqa: B019
    def _other(self, kind: str, text: str) -> str:
        keep = [m.span() for m in re.finditer(r"[^\W\d_]+", text) if m.group().lower() in _KEPT_WORDS] if kind in ("address", "email") else []
        if kind == "phone":  # the country code, or the trunk zero, says where the number belongs
            keep = [m.span() for m in [re.match(r"\+\d{3}|00\d{3}|\(?0", text)] if m] + [m.span() for m in re.finditer(r"(?i)ext|x|ramal|loc\w*", text)]
        if kind == "identity_number":
            keep = [m.span() for m in re.finditer(r"[A-Za-z]+", text)]
        if kind in ("phone", "identity_number"):  # one number in two layouts stays one number
            digits = [i for i, c in enumerate(text) if c.isdigit() and not any(a <= i < b for a, b in keep)]
            new = self.permute([int(text[i]) for i in digits], 10, kind)
            out = list(text)
            for i, v in zip(digits, new):
                out[i] = str(v)
            return "".join(out)
        return self.scramble(text, kind, keep)


def apply_spans(text: str, spans: list[Span], replacements: list[str]) -> str:
    out, at = [], 0
    for s, new in zip(spans, replacements):
        out += [text[at : s.start], new]
        at = s.end
    return "".join([*out, text[at:]])


def protect_documents(docs: DataFrame, name_parts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str, texts: bool = True, originals: bool = False) -> DataFrame:
    """``id_col``, ``entities`` (array of kind, start_pos, end_pos, surrogate and, with ``originals``, original) and,
    with ``texts``, the text twice: ``redacted`` with typed placeholders and ``text_surrogate`` with surrogates.

    Positions count code points from 0, the end exclusive; spans are ordered and do not overlap.

    Defined cases: a null text stays null and has no entities, an empty or blank text stays as it is; text
    of any length is searched whole; repeated rows get the same result; an empty list of name parts finds
    no names but all other kinds; null parts are ignored; an empty table gives an empty result; other
    columns are not read.

    Scale: no shuffle where the scan has a part per core; each task streams Arrow batches cut by text size. Only the list of name parts is sent
    to tasks, after a check that it has at most ``MAX_PARTS`` rows.
    """
    listed = name_parts.where("name_part is not null and position is not null").select("name_part", "position").distinct().take(MAX_PARTS + 1)
    if len(listed) > MAX_PARTS:
        raise ValueError(f"the list of name parts has more than {MAX_PARTS} rows")
    parts = sorted((r[0], r[1]) for r in listed)
    kind = docs.schema[id_col].dataType.simpleString()
    entity = pa.struct([("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("surrogate", pa.string()), *[("original", pa.string())] * originals])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = NameLexicon(parts)
        made = Surrogates(key, lexicon)
        for batch in batches:
            for piece in slices(batch, 1):
                rows, redacted, replaced = [], [], []
                for text in piece.column(1).to_pylist():
                    spans = find_entities(text, lexicon)
                    new = [made.replace(s.kind, text[s.start : s.end]) for s in spans]
                    rows.append([{"kind": s.kind, "start_pos": s.start, "end_pos": s.end, "surrogate": r} | ({"original": text[s.start : s.end]} if originals else {}) for s, r in zip(spans, new)])
                    if texts:
                        redacted.append(None if text is None else apply_spans(text, spans, [PLACEHOLDERS[s.kind] for s in spans]))
                        replaced.append(None if text is None else apply_spans(text, spans, new))
                columns = [piece.column(0), pa.array(rows, pa.list_(entity))] + ([pa.array(redacted, pa.string()), pa.array(replaced, pa.string())] if texts else [])
                yield pa.RecordBatch.from_arrays(columns, names=["id", "entities", "redacted", "text_surrogate"][: len(columns)])

    schema = f"id {kind}, entities array<struct<kind:string,start_pos:int,end_pos:int,surrogate:string{',original:string' * originals}>>" + (", redacted string, text_surrogate string" if texts else "")
    out = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), *out.columns[1:])


def protect_checked(docs: DataFrame, name_parts: DataFrame, *, key: str, **options: str) -> DataFrame:
    """``protect_documents`` with the collision check on all its entities: written once, read for the check, then returned.

    A surrogate that stands for two different entities, or an entity with two surrogates, raises
    ``ContractError`` with the numbers by kind, before any protected text is handed out.
    """
    made = written(protect_documents(docs, name_parts, key=key, originals=True, **options), "protected")
    entities = made.select(F.explode("entities").alias("e")).select("e.kind", "e.original", "e.surrogate")
    bad = [r.asDict() for r in surrogate_accounting(entities).where("collisions > 0 or splits > 0").collect()]  # one row per kind
    if bad:
        raise ContractError(f"surrogates are not distinct: {bad}")
    without = F.transform("entities", lambda e: e.dropFields("original"))
    return made.withColumn("entities", without)


def _plain_pairs(entities: DataFrame) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return entities.select("kind", plain(F.col("original")).alias("original"), plain(F.col("surrogate")).alias("surrogate")).distinct()


def surrogate_collisions(entities: DataFrame) -> DataFrame:
    """``kind``, ``surrogate`` and the number of different originals behind it, where more than one.

    ``entities``: ``kind``, ``original``, ``surrogate``. Originals that differ in layout or letter case only
    count as one. An empty result is the proof of distinctness for a corpus.
    """
    return _plain_pairs(entities).groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).where("originals > 1")


def surrogate_accounting(entities: DataFrame) -> DataFrame:
    """By ``kind``: different originals, ``collisions`` (surrogates of several originals) and ``splits`` (originals with several surrogates)."""
    pairs = _plain_pairs(entities)
    collisions = surrogate_collisions(entities).groupBy("kind").agg(F.count("*").alias("collisions"))
    splits = pairs.groupBy("kind", "original").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count("*").alias("originals"), F.count_if(F.col("n") > 1).alias("splits"))
    return splits.join(collisions, "kind", "left").select("kind", "originals", F.coalesce("collisions", F.lit(0)).alias("collisions"), "splits")

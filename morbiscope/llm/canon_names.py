"""Freely typed names mapped to a canonical list: a trie of the entries searched with a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morbiscope.functions import normal as N
from morbiscope.runtime import written

UNMATCHED = "UNMATCHED"
#: Entries of the reference list one trie holds; a longer list is searched in blocks of this size.
BLOCK_ENTRIES = 50_000
EXACT, ALIAS, PREFIX, ELSEWHERE, FUZZY_ALIAS = 0.0, 0.25, 0.4, 0.5, 0.25
LEAST_PREFIX = 4
MOST_EDITS = 3

# Words that name the kind of a unit, or say that a figure is its sum.
QUALIFIERS = (
    "province of", "province", "provinsi", "propinsi", "prov", "region of", "region", "rehiyon ng", "rehiyon",
    "state of", "state", "negeri", "division", "div", "district", "daerah", "municipality of", "municipality",
    "municipio de", "municipio", "changwat", "ch", "khaet", "khoueng", "all districts", "total",
)
# The four directions as official names and typed forms write them.
DIRECTIONS = (
    ("north", "northern", "norte", "utara", "nth", "nrt", "nte", "utr", "n", "u"),
    ("south", "southern", "sur", "selatan", "sul", "sth", "stan", "slt", "sltn", "sel", "s"),
    ("east", "eastern", "leste", "timur", "lst", "tmr", "tim", "e", "l", "t"),
    ("west", "western", "oeste", "barat", "ost", "brt", "bar", "w", "o", "b"),
)
# Digits that stand for letters in scanned text.
DIGIT_LETTERS = str.maketrans("01345689", "oleasgbg")
# Letter groups that scanning or spelling by ear exchanges; each counts as one edit.
CONFUSED = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("oo", "u"), ("ii", "u"), ("ee", "i"), ("ph", "f"), ("ck", "k"), ("ks", "x"))


# The pairs of letters that stand for one letter, and the letter that a pair stands for.
_GROUPS_OF = {one: tuple(two for two, o in CONFUSED if o == one) for _, one in CONFUSED}
_SINGLE_OF = {two: one for two, one in CONFUSED}

_MOJIBAKE = re.compile("[ÃãÂâÄäÅåÆæá»º][\x80-\xbf‘’“”•–—˜™š›œžŸ€‚ƒ„…†‡ˆ‰Š‹ŒŽ]")


def _repair(pair: re.Match) -> str:
    text = pair.group()
    for first in (text[0], text[0].upper()):
        for codec in ("latin-1", "cp1252"):
            try:
                return (first + text[1:]).encode(codec).decode("utf-8")
            except UnicodeError:
                pass
    return text


def fold(text: str) -> str:
    """Lower-case letters without accents, wrongly decoded letters restored; the rest as single spaces."""
    text = _MOJIBAKE.sub(_repair, text)
    text = unicodedata.normalize("NFKD", text.lower().replace("đ", "d").replace("ø", "o").replace("ł", "l").replace("ı", "i"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"^[\W_]*\d+\s*[.):-]\s+", "", text)  # a list number
    text = re.sub(r"\[[a-z]{3}\]", " ", text)  # a country code
    return re.sub(r"[^a-z]+", " ", re.sub(r"['’`´]", "", text.translate(DIGIT_LETTERS))).strip()


def _plain_variants(text: str) -> Iterator[str]:
    """The compact text, and what is left of it without qualifiers at its ends."""
    compact = text.replace(" ", "")
    seen, todo = {compact}, [compact]
    while todo:
        now = todo.pop()
        yield now
        for q in QUALIFIERS:
            q = q.replace(" ", "")
            for shorter in (now[len(q) :] if now.startswith(q) else "", now[: -len(q)] if now.endswith(q) else ""):
                if len(shorter) >= LEAST_PREFIX and shorter not in seen:
                    seen.add(shorter)
                    todo.append(shorter)


def alias_forms(name: str) -> dict[str, float]:
    """Compact forms under which ``name`` is found, each with the cost of being no full form."""
    words = fold(name).split()
    if not words:
        return {}
    forms = {"".join(words): EXACT}
    if len(words) > 1:
        forms.setdefault("".join(reversed(words)), EXACT)
        head, tail = "".join(words[:-1]), words[-1]
        short = {tail[0]}
        for group in DIRECTIONS:
            if tail in group:
                short |= {w for w in group if len(w) > 1 or w in (group[0][0], tail[0])}
        for form in short - {tail}:
            for whole in (head + form, form + head):
                forms.setdefault(whole, ALIAS)
        forms.setdefault(words[0][0] + "".join(words[1:]), ALIAS)
    return forms


def edit_limit(length: int) -> int:
    """Edits a typed name may be away from an entry of ``length`` letters."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 9 else 3


def walk_limit(length: int) -> int:
    """The most edits that a typed form of ``length`` letters may be away from any entry it can mean."""
    return max(min(edit_limit(n), MOST_EDITS) for n in range(max(length - MOST_EDITS, 0), length + MOST_EDITS + 1) if abs(n - length) <= edit_limit(n))


def cost(typed: str, entry: str) -> int:
    """Edits between two words: letters inserted, left out, exchanged or swapped, and confused groups."""
    n, m = len(typed), len(entry)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                table[i][j] = i + j
                continue
            best = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (typed[i - 1] != entry[j - 1]))
            if i > 1 and j > 1 and typed[i - 1] == entry[j - 2] and typed[i - 2] == entry[j - 1]:
                best = min(best, table[i - 2][j - 2] + 1)
            for a, b in CONFUSED:
                for x, y in ((a, b), (b, a)):
                    if typed.endswith(x, 0, i) and entry.endswith(y, 0, j):
                        best = min(best, table[i - len(x)][j - len(y)] + 1)
            table[i][j] = best
    return table[n][m]


class Trie:
    """Entries by letter; ``within`` walks it with the bit-parallel automaton of the typed word."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.forms: list[str | None] = [None]

    def add(self, form: str) -> None:
        at = 0
        for c in form:
            nxt = self.children[at].get(c)
            if nxt is None:
                nxt = self.children[at][c] = len(self.children)
                self.children.append({})
                self.forms.append(None)
            at = nxt
        self.forms[at] = form

    def within(self, word: str, edits: int) -> list[str]:
        """Every form at most ``edits`` away: insertions, deletions, exchanges, swaps of neighbours and confused groups.

        State: for each number of edits the set (bit i = first i letters of ``word`` read) of positions
        reachable, and the set of swaps begun. A confused group is one transition: two letters of the word
        for one of the form from the state before it, or one for two from the state before the letter before.
        A branch ends where no position is left.
        """
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        pairs: dict[str, int] = {}
        for i in range(len(word) - 1):
            pairs[word[i : i + 2]] = pairs.get(word[i : i + 2], 0) | 1 << i
        full, done = (1 << (len(word) + 1)) - 1, 1 << len(word)
        start = [(1 << (j + 1)) - 1 & full for j in range(edits + 1)]
        found, todo = [], [(0, "", start, [0] * (edits + 1), [0] * (edits + 1))]
        while todo:
            node, letter, old, older, swaps = todo.pop()
            form = self.forms[node]
            if form is not None and old[edits] & done:
                found.append(form)
            for c, child in self.children[node].items():
                m = masks.get(c, 0)
                two_for_one = 0
                for group in _GROUPS_OF.get(c, ()):
                    two_for_one |= pairs.get(group, 0)
                one_for_two = masks.get(_SINGLE_OF.get(letter + c, ""), 0)
                new, begun = [(old[0] & m) << 1], [0]
                for j in range(1, edits + 1):
                    low = old[j - 1]
                    reach = ((old[j] & m) << 1) | low | (low << 1) | (new[j - 1] << 1) | ((swaps[j] & m) << 2)
                    new.append((reach | ((low & two_for_one) << 2) | ((older[j - 1] & one_for_two) << 1)) & full)
                    begun.append(low & (m >> 1))
                if new[edits]:
                    todo.append((child, c, new, old, begun))
        return found


class NameMatcher:
    """Units of one block of the reference list, by country."""

    def __init__(self, entries: Iterable[tuple[str, str | None, str | None]], elsewhere: Iterable[str] = (), aliases: Iterable[tuple[str, str | None, str | None]] = ()):
        """``entries``: (country, name or null, unit); ``elsewhere``: names of countries; ``aliases``: other names of units."""
        self.tries: dict[str, Trie] = {}
        self.units: dict[str, dict[str, list[tuple[str, float]]]] = {}
        self.prefixes: dict[str, dict[str, set[str]]] = {}
        self.other = {x for name in elsewhere for x in [fold(name).replace(" ", "")] if x}
        for country, name, unit in entries:
            if not name or unit is None:
                continue
            trie, units = self.tries.setdefault(country, Trie()), self.units.setdefault(country, {})
            for form, extra in alias_forms(name).items():
                trie.add(form)
                units.setdefault(form, []).append((unit, extra))
                if extra == EXACT:
                    self.other.add(form)
                    for n in range(LEAST_PREFIX, len(form)):
                        self.prefixes.setdefault(country, {}).setdefault(form[:n], set()).add(unit)
        for country, alias, unit in aliases:
            form = fold(alias).replace(" ", "") if alias else ""
            if form and unit is not None:
                self.tries.setdefault(country, Trie()).add(form)
                self.units.setdefault(country, {}).setdefault(form, []).append((unit, ALIAS))

    def match(self, country: str, name: str) -> list[tuple[str | None, float]]:
        """The units that fit best, with their cost; a null unit means a place that is none of the country."""
        return self._match(country, fold(name))

    def within(self, country: str, name: str) -> dict[str, float]:
        """Every unit with a form within the distance that its length allows, with the least cost."""
        found = {u: p for u, p in self._listed(country, fold(name)).items() if u is not None}
        for unit, price in self._walked(country, fold(name), MOST_EDITS).items():
            found[unit] = min(price, found.get(unit, price))
        return found

    def _listed(self, country: str, folded: str) -> dict[str | None, float]:
        """Units that have a variant of the name as a form or as a beginning."""
        best: dict[str | None, float] = {}
        units, prefixes = self.units.get(country, {}), self.prefixes.get(country, {})
        for v in filter(None, _plain_variants(folded)):
            for unit, extra in units.get(v, ()):
                best[unit] = min(extra, best.get(unit, extra))
            for unit in prefixes.get(v, ()):
                best[unit] = min(PREFIX, best.get(unit, PREFIX))
            if v in self.other and v not in units:
                best[None] = min(ELSEWHERE, best.get(None, ELSEWHERE))
        return best

    def _walked(self, country: str, folded: str, widest: int) -> dict[str | None, float]:
        """Units that the automaton of a variant finds in the trie, at most ``widest`` edits away."""
        best: dict[str | None, float] = {}
        trie, units = self.tries.get(country), self.units.get(country, {})
        if trie is None:
            return best
        for v in filter(None, _plain_variants(folded)):
            edits = min(widest, walk_limit(len(v)))
            for form in trie.within(v, edits) if edits else ():
                price = cost(v, form)
                for unit, extra in units[form]:
                    if price <= min(widest, edit_limit(len(form)), MOST_EDITS if extra == EXACT else 2):
                        whole = price + (FUZZY_ALIAS if extra else 0)
                        best[unit] = min(whole, best.get(unit, whole))
        return best

    @lru_cache(maxsize=200_000)  # noqa: B019
    def _match(self, country: str, folded: str) -> list[tuple[str | None, float]]:
        # A walk costs as its width, so the widest is left to words that nothing closer was found for.
        best = self._listed(country, folded) or self._walked(country, folded, 2) or self._walked(country, folded, MOST_EDITS)
        least = min(best.values(), default=0)
        return [(u, p) for u, p in best.items() if p == least]


def match_names(names: DataFrame, reference: DataFrame, block_entries: int = BLOCK_ENTRIES, aliases: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(``country``, ``name``) of ``names`` with ``units``: all units that fit equally well (may be empty).

    With ``every`` instead one row per name and unit within the distance that the entry's length allows,
    with its ``price``. ``aliases`` (``country``, ``alias``, ``unit``) lists further names of units.

    Matching costs CPU time, not bytes, so the names are dealt to ``spark.sql.shuffle.partitions`` tasks by number
    and each block of the list is matched once and written. The list is read in blocks of ``block_entries``
    entries, one after the other: neither the driver nor a worker ever holds more than one, and the best of all
    blocks holds.
    """
    spark = names.sparkSession
    ref = reference.where("country is not null").select("country", "name", "unit", "country_name", F.lit(False).alias("other")).distinct()
    if aliases is not None:
        ref = ref.unionByName(aliases.where("country is not null").select("country", F.col("alias").alias("name"), "unit", F.lit(None).cast("string").alias("country_name"), F.lit(True).alias("other")).distinct())
    blocks = max(1, -(-ref.count() // block_entries))
    block = F.pmod(F.xxhash64("country", "name", "unit"), F.lit(blocks))
    dealt = names.select("country", "name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    if blocks > 1:
        dealt = written(dealt, "typed-names-dealt")
    found = None
    for b in range(blocks):
        rows = (ref.where(block == b) if blocks > 1 else ref).collect()  # about block_entries rows
        entries = [(r["country"], r["name"], r["unit"]) for r in rows if not r["other"]]
        more = [(r["country"], r["name"], r["unit"]) for r in rows if r["other"]]
        elsewhere = sorted({r["country_name"] for r in rows if r["country_name"]})

        def run(batches: Iterator[pa.RecordBatch], entries=entries, elsewhere=elsewhere, more=more) -> Iterator[pa.RecordBatch]:
            matcher = NameMatcher(entries, elsewhere, more)
            for batch in batches:
                out: list[tuple] = []
                for country, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if every:
                        out += [(country, name, [u], p) for u, p in sorted(matcher.within(country, name).items())]
                        continue
                    hits = matcher.match(country, name)
                    out.append((country, name, [u for u, _ in hits if u is not None] if (None not in dict(hits)) else [], min((p for _, p in hits), default=99.0)))
                columns = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.float64())],
                    names=["country", "name", "units", "price"],
                )

        part = written(dealt.mapInArrow(run, "country string, name string, units array<string>, price double"), "matched-names")
        found = part if found is None else found.unionByName(part)
    if every:
        return found.select("country", "name", F.explode("units").alias("unit"), "price").groupBy("country", "name", "unit").agg(F.min("price").alias("price"))
    if blocks == 1:
        return found.select("country", "name", "units")
    least = found.groupBy("country", "name").agg(F.min("price").alias("price"))
    return found.join(least, ["country", "name", "price"]).groupBy("country", "name").agg(F.array_distinct(F.flatten(F.collect_list("units"))).alias("units"))


def map_names(rows: DataFrame, reference: DataFrame, *, id_col: str, learn_from: DataFrame | None = None, block_entries: int = BLOCK_ENTRIES, aliases: DataFrame | None = None) -> DataFrame:
    """``id_col`` and ``unit`` of every row, ``UNMATCHED`` where no unit is meant.

    ``rows``: ``id_col``, ``country``, ``name``, ``code``; ``reference``: ``country``, ``name``, ``unit``,
    ``country_name``; ``learn_from``: ``country``, ``code``, ``unit`` of rows whose unit is certain; ``aliases``:
    ``country``, ``alias``, ``unit``, further names of units.

    The name decides. Only where it fits several units equally well, the row's code chooses among these: the
    unit most of whose certain rows carry that code (codes need not be numbered like units, and may be
    wrong). If the code is missing or unknown for all of them the row is reported as unmatched.

    Defined cases: null or empty names and null countries are unmatched; ties between units whose share of
    the code is equal go to the smaller unit; repeated rows get the same answer; empty tables are allowed;
    columns not named are ignored; names of any length are compared whole.

    Scale: distinct (country, name) pairs are matched once, after a map-side-combined distinct; rows meet
    their answer in an equi-join that AQE may split at a hot name or broadcast when measured as small.
    """
    names = rows.where("country is not null and name is not null").select("country", "name").distinct()
    answers = match_names(names, reference, block_entries, aliases)
    joined = rows.join(answers, ["country", "name"], "left").select(id_col, "country", "code", "units")
    sure = joined.where("units is null or size(units) <= 1").select(id_col, F.coalesce(F.get("units", F.lit(0)), F.lit(UNMATCHED)).alias("unit"))
    open_rows = joined.where("size(units) > 1")
    if learn_from is None:
        return sure.unionByName(open_rows.select(id_col, F.lit(UNMATCHED).alias("unit")))
    counts = learn_from.where("code is not null").groupBy("country", "code", "unit").agg(F.count("*").alias("n"))
    share = counts.select("country", "code", "unit", (F.col("n") / F.sum("n").over(Window.partitionBy("country", "unit"))).alias("share"))
    choices = open_rows.select("country", "code", "units").distinct().select("country", "code", "units", F.explode("units").alias("unit"))
    chosen = (
        choices.join(share, ["country", "code", "unit"])
        .groupBy("country", "code", "units")
        .agg(F.min(F.struct((-F.col("share")).alias("s"), "unit")).alias("best"))
        .select("country", "code", "units", F.col("best.unit").alias("unit"))
    )
    settled = open_rows.join(chosen, ["country", "code", "units"], "left").select(id_col, F.coalesce("unit", F.lit(UNMATCHED)).alias("unit"))
    return sure.unionByName(settled)


def normal_code(code: Column) -> Column:
    """``PH-9``, ``ph09`` and ``PH-09`` alike; codes without a number, and numbers alone, are null."""
    squeezed = F.regexp_replace(N.key_upper(code), r"[^A-Z0-9]", "")
    number = F.regexp_replace(squeezed, r"^([A-Z]+)0*(\d+)$", "$1$2")
    return F.when(number.rlike(r"^[A-Z]+\d+$"), number)


def opendengue_names(opendengue: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``record_id``, ``p_code`` of the Admin1 rows outside VNM whose typed name is not canonical."""
    c = F.col
    typed = opendengue.where((N.key_lower(c("S_res")) == "admin1") & ~N.is_placeholder(c("adm_1_name"))).select(
        "record_id", N.key_upper(c("ISO_A0")).alias("country"), N.trim_all(c("adm_1_name")).alias("name"), normal_code(c("RNE_iso_code")).alias("code")
    )
    typed = typed.where("country is null or country <> 'VNM'").withColumn("key", F.lower("name"))
    listed = boundaries.where("adm_1_name is not null").select(c("iso3").alias("country"), F.lower("adm_1_name").alias("key"), c("p_code").alias("unit")).groupBy("country", "key").agg(F.min("unit").alias("unit"))
    marked = written(typed.join(listed, ["country", "key"], "left"), "typed-names")  # read several times below
    reference = boundaries.select(c("iso3").alias("country"), c("adm_1_name").alias("name"), c("p_code").alias("unit"), c("adm_0_name").alias("country_name"))
    found = map_names(
        marked.where("unit is null").drop("unit", "key"),
        reference,
        id_col="record_id",
        learn_from=marked.where("unit is not null").select("country", "code", "unit"),
    )
    return found.select("record_id", c("unit").alias("p_code"))


__all__: Sequence[str] = ["NameMatcher", "Trie", "alias_forms", "cost", "fold", "map_names", "match_names", "opendengue_names"]

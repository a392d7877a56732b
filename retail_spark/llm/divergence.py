"""How far each source's word use is from that of its language and of the other sources: exact integer divergences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_spark.functions.scale import number_rows
from retail_spark.llm import transducer
from retail_spark.session import discard, materialise

# Fixed values of the contract.
MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200

#: Kept terms of a slice of the vocabulary, on average; each language of a slice has its transducer.
SLICE = 512
#: Distinct terms, and words, that a task counts before it gives them out.
HELD, WORDS = 400_000, 4_000_000
#: Cells that wait in a slice before they are summed.
COMPACT = 2_000_000
#: Rows of a batch given out.
ROWS = 8192
#: Terms and sources of one block of the pairwise sums.
CHUNK, TILE = 1024, 256

#: A-Z lower-cased; letters and all bytes beyond ASCII stay; everything else parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def _document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many texts of a language a term occurs, summed per task only.

    A task gives its counts out whenever it holds HELD of them, so its memory is bounded; a term may come several times.
    """
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def given(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(counts), pa.string()), terms, pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = held.setdefault(lang, Counter())
                before = len(counts)
                counts.update(set(_words(text)))
                size += len(counts) - before
                if size >= HELD:
                    yield from given(held)
                    held, size = {}, 0
        yield from given(held)

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, n bigint")


class _Numbers(dict):
    """Numbers its keys 0, 1, ... as they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


class _Occurrences:
    """The terms of one language's texts by source, as numbers."""

    def __init__(self) -> None:
        self.terms, self.sources = _Numbers(), _Numbers()
        self.codes: list[np.ndarray] = []
        self.source_of: list[int] = []

    def add(self, source: str, words: list[bytes]) -> None:
        self.codes.append(np.array(list(map(self.terms.__getitem__, words)), np.int32))
        self.source_of.append(self.sources[source])

    def summed(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(terms, their sources, their occurrences under each)."""
        width = len(self.sources)
        keys = np.concatenate(self.codes).astype(np.int64) * width
        keys += np.repeat(self.source_of, [len(c) for c in self.codes])
        keys.sort()
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        n, keys = np.diff(at, append=len(keys)), keys[at]
        bounds = np.searchsorted(keys, np.arange(len(self.terms) + 1) * width).astype(np.int32)
        names = pa.array(list(self.sources), pa.string()).take(pa.array(keys % max(width, 1)))
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        return terms, pa.ListArray.from_arrays(pa.array(bounds), names), pa.ListArray.from_arrays(pa.array(bounds), pa.array(n))


def _source_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, sources, ns): how often a term occurs under each source of a language, summed per task only.

    A task gives its sums out whenever it holds WORDS words, so its memory is bounded; a term may come several times.
    """
    kind = [("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("ns", pa.list_(pa.int64()))]

    def given(held: dict[str, _Occurrences]) -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            if found.terms:
                columns = found.summed()
                langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(columns[0]), np.int32)))
                yield from pa.Table.from_arrays([langs, *columns], schema=pa.schema(kind)).to_batches(max_chunksize=ROWS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Occurrences] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words(text)
                held.setdefault(lang, _Occurrences()).add(source, words)
                size += len(words)
                if size >= WORDS:
                    yield from given(held)
                    held, size = {}, 0
        yield from given(held)

    ddl = "lang string, term string, sources array<string>, ns array<bigint>"
    return docs.select("lang", "source", "text").mapInArrow(count, ddl)


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, ordinal): terms in enough documents of their language, numbered by language and term in byte order."""
    found = (
        _document_counts(docs)
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("_documents"))
        .filter(F.col("_documents") >= min_documents)
    )
    return number_rows(found.select("lang", "term"), ["lang", "term"], "ordinal", "kept_terms")


def _slice_of(slices: int) -> Column:
    return F.pmod(F.xxhash64("lang", "term"), F.lit(slices)).cast("int")


def transducers(kept: DataFrame, slices: int) -> DataFrame:
    """(slice, machine): a transducer for each language's terms of a slice, in one pickled map from language to machine and ordinals.

    Slices are dealt by hash, so a term's slice is known without a list of borders, and each holds about SLICE terms. A
    machine says which of its terms a word is; the ordinals beside it, ascending, are those of the whole vocabulary.
    """

    def made(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ordinal", "ascending")])
        langs = np.array(rows["lang"].to_pylist(), object)
        terms, ordinals = rows["term"].to_pylist(), rows["ordinal"].to_numpy()
        machines = {}
        for lang in dict.fromkeys(langs):
            places = np.flatnonzero(langs == lang)
            machine = transducer.build(terms[i].encode() for i in places)
            machines[lang] = (machine.dumps(), ordinals[places].tobytes())
        return pa.table(
            {"slice": pa.array([rows["slice"][0].as_py()], pa.int32()), "machine": pa.array([transducer.packed(machines)], pa.binary())}
        )

    return kept.withColumn("slice", _slice_of(slices)).groupBy("slice").applyInArrow(made, "slice int, machine binary")


class _Cells:
    """Occurrences of one slice's terms by language and source. Summed up whenever COMPACT of them wait, so memory is bounded."""

    def __init__(self, machines: dict[str, tuple[transducer.Transducer, np.ndarray]]):
        self.machines = machines
        self.sources: dict[tuple[str, str], int] = {}
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.waiting = 0

    def add(self, rows: pa.Table) -> None:
        """Runs the rows' terms through their language's transducer."""
        for lang in pa.compute.unique(rows["lang"]).to_pylist():
            if lang not in self.machines:
                continue
            of_lang = rows.filter(pa.compute.equal(rows["lang"], lang))
            machine, ordinals = self.machines[lang]
            places = [machine.ordinal(t) for t in of_lang["term"].cast(pa.binary()).to_pylist()]
            found = np.flatnonzero([p is not None for p in places])
            if not len(found):
                continue
            kept = of_lang.take(pa.array(found)).combine_chunks()
            names, ns = kept["sources"].chunk(0), kept["ns"].chunk(0)
            ordinal = ordinals[[places[i] for i in found]]
            coded = names.flatten().dictionary_encode()
            code = np.array([self.sources.setdefault((lang, s), len(self.sources)) for s in coded.dictionary.to_pylist()], np.int64)
            per_row = pa.compute.list_value_length(names).to_numpy()
            # ordinals number the terms of all languages, so an ordinal and a source make a cell
            self.keys.append(np.stack([np.repeat(ordinal, per_row), code[coded.indices.to_numpy()]]))
            self.n.append(ns.flatten().to_numpy())
            self.waiting += len(self.n[-1])
            if self.waiting >= COMPACT:
                self._sum()
                self.waiting = 0

    def _sum(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate(self.keys, axis=1), np.concatenate(self.n)
        order = np.lexsort(keys[::-1])
        keys, n = keys[:, order], n[order]
        first = np.ones(len(n), bool)
        first[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        at = np.flatnonzero(first)
        keys, n = keys[:, at], np.add.reduceat(n, at)
        self.keys, self.n = [keys], [n]
        return keys, n

    def given(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        (ordinal, source), n = self._sum()
        first = np.ones(len(n), bool)
        first[1:] = ordinal[1:] != ordinal[:-1]
        at = np.flatnonzero(first)
        of_lang = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(n))))
        langs, names = (pa.array(list(x), pa.string()) for x in zip(*self.sources, strict=True))
        source = pa.array(source)
        table = pa.table(
            {"lang": langs.take(source), "source": names.take(source), "ordinal": ordinal, "n": n, "lang_n": of_lang}
        )
        yield from table.to_batches(max_chunksize=ROWS)


def recount(docs: DataFrame, machines: DataFrame, slices: int) -> DataFrame:
    """(lang, source, ordinal, n, lang_n): occurrences of every kept term under every source that has it, and in its language.

    The texts are read again; each task sums their words by source and sends them to the slice they belong to. There
    they run through the slice's transducers, which come first and are the only ones held. A term has as many rows as tasks met it,
    however common it is, and a slice has about SLICE kept terms, so slices are of like size.
    """
    words = _source_counts(docs).select(_slice_of(slices).alias("slice"), F.lit(None).cast("binary").alias("machine"), "*")
    none = {"lang": "string", "term": "string", "sources": "array<string>", "ns": "array<bigint>"}
    first = machines.select("slice", "machine", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = None, None
        for batch in batches:
            slices = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                rows = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if slices[begin] != at:
                    if cells:
                        yield from cells.given()
                    at, machine = slices[begin], rows["machine"][0].as_py()
                    cells = _Cells(transducer.unpacked(machine)) if machine else None  # no kept term has this slice
                    rows = rows.slice(1) if machine else rows
                if cells:
                    cells.add(rows)
        if cells:
            yield from cells.given()

    return (
        words.unionByName(first)
        .repartition("slice")
        .sortWithinPartitions("slice", F.col("machine").isNull())
        .mapInArrow(run, "lang string, source string, ordinal bigint, n bigint, lang_n bigint")
    )


def scaled(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly while total is below 9 * 10^15: long division, three digits a step."""
    whole = F.lit(0).cast("bigint")
    rest = count + 1
    for step in (1, 1000, 1000, 1000):
        rest = rest * step
        whole = whole * 1000 + F.call_function("div", rest, total)
        rest = rest % total
    return whole + 1


def _scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def groups_of(docs: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, place, total, terms): every group that occurs, its number within the language, kept words and kept terms."""
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    named = docs.groupBy("lang", "source").agg(F.count(F.lit(1)))
    return (
        named.join(sums, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select(
            "lang",
            "source",
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"),
            F.coalesce("_n", F.lit(0)).cast("bigint").alias("total"),
            F.coalesce("terms", F.lit(0)).cast("bigint").alias("terms"),
        )
    )


def pair_sums(kept: DataFrame, counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the divergence of group a from group b over all kept terms of their language, by places.

    Terms are cut into chunks of CHUNK, sources into tiles of TILE: one task group holds the counts of two tiles in one
    chunk as two matrices, whatever the number of terms and sources, and gives one number a pair of sources.
    """
    chunk = F.floor(F.col("ordinal") / CHUNK)
    tiles = groups.groupBy("lang").agg((F.floor(F.max("place") / TILE) + 1).cast("int").alias("tiles"))
    known = groups.filter(F.col("terms") > 0).join(tiles, "lang")
    chunks = kept.groupBy("lang", chunk.alias("chunk")).agg(
        F.min("ordinal").alias("first"), F.count(F.lit(1)).cast("int").alias("width")
    )
    heads = known.join(chunks, "lang").select(
        "lang", "chunk", "place", "tiles", (F.col("total") + F.col("terms")).alias("total"), "first", "width",
        F.lit(None).cast("bigint").alias("ordinal"), F.lit(None).cast("bigint").alias("n"),
    )
    cells = counts.join(known.select("lang", "source", "place", "tiles"), ["lang", "source"]).select(
        "lang", chunk.alias("chunk"), "place", "tiles", F.lit(None).cast("bigint").alias("total"),
        F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("int").alias("width"), "ordinal", "n",
    )
    own = F.floor(F.col("place") / TILE).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    meetings = F.array_distinct(
        F.concat(
            F.transform(others, lambda t: F.struct(own.alias("left"), t.alias("right"))),
            F.transform(others, lambda t: F.struct(t.alias("left"), own.alias("right"))),
        )
    )

    def sums(rows: pa.Table) -> pa.Table:
        lang, left, right = (rows[c][0].as_py() for c in ("lang", "left", "right"))
        head = rows.filter(pa.compute.is_valid(rows["first"]))
        cell = rows.filter(pa.compute.is_valid(rows["ordinal"]))
        first, width = head["first"][0].as_py(), head["width"][0].as_py()
        places, at = head["place"].to_numpy(), {p: i for i, p in enumerate(head["place"].to_pylist())}
        matrix = np.zeros((len(places), width), np.int64)
        matrix[[at[p] for p in cell["place"].to_pylist()], cell["ordinal"].to_numpy() - first] = cell["n"].to_numpy()
        matrix = _scaled(matrix, head["total"].to_numpy()[:, None])
        a, b = np.flatnonzero(places // TILE == left), np.flatnonzero(places // TILE == right)
        out = np.zeros((len(a), len(b)), np.int64)
        for i, row in enumerate(a):
            away = matrix[row] - matrix[b]
            out[i] = (away * away // matrix[b]).sum(axis=1)
        n = out.size
        return pa.table(
            {
                "lang": pa.array([lang] * n, pa.string()), "a": pa.array(np.repeat(places[a], len(b)), pa.int32()),
                "b": pa.array(np.tile(places[b], len(a)), pa.int32()), "value": pa.array(out.ravel(), pa.int64()),
            }
        )

    return (
        heads.unionByName(cells)
        .withColumn("_meeting", F.explode(meetings))
        .select("lang", "chunk", "_meeting.left", "_meeting.right", "place", "total", "first", "width", "ordinal", "n")
        .groupBy("lang", "chunk", "left", "right")
        .applyInArrow(sums, "lang string, a int, b int, value bigint")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
        .filter("a <> b")
    )


def term_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, ordinal, value): terms that a group uses more than its language does, with their part of the divergence."""
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("_lang_total"))
    p = scaled(F.col("n"), F.col("total") + F.col("terms"))
    q = scaled(F.col("lang_n"), F.col("_lang_total") + F.col("terms"))
    away = F.col("p") - F.col("q")
    return (
        counts.join(groups.join(of_lang, "lang"), ["lang", "source"])
        .select("lang", "source", "ordinal", p.alias("p"), q.alias("q"))
        .filter("p > q")
        .select("lang", "source", "ordinal", F.call_function("div", away * away, F.col("q")).alias("value"))
    )


def divergences(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """One row per ordered pair of sources of a language, and per strongest term of a source: the contract's columns.

    Null text, lang and source are empty texts: '' is a language and a source like any other. Every row counts as a
    document, repeated ones too. A language without kept terms gives its pairs with value 0 and no terms; a language with
    one source gives no pair; an empty table gives no rows. Equal values rank by item: terms by their ordinals, which
    follow byte order. Other columns are passed over.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialise(kept_terms(docs, min_documents), "kept_terms")
    slices = max(1, -(-kept.count() // SLICE))
    machines = materialise(transducers(kept, slices), "transducers")
    counts = materialise(recount(docs, machines, slices), "recounted")
    discard(machines)
    groups = materialise(groups_of(docs, kept, counts), "groups")

    by_value = Window.partitionBy("lang", "source")
    names = groups.select("lang", F.col("place").alias("a"), "source")
    others = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    empty = groups.filter("terms = 0")
    nothing = (
        empty.select("lang", F.col("place").alias("a"))
        .join(empty.select("lang", F.col("place").alias("b")), "lang")
        .filter("a <> b")
        .withColumn("value", F.lit(0).cast("bigint"))
    )
    pairs = (
        pair_sums(kept, counts, groups)
        .unionByName(nothing)
        .join(names, ["lang", "a"])
        .join(others, ["lang", "b"])
        .withColumn("rank", F.row_number().over(by_value.orderBy(F.desc("value"), "item")))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )
    best = (
        term_values(counts, groups)
        .withColumn("rank", F.row_number().over(by_value.orderBy(F.desc("value"), "ordinal")))
        .filter(F.col("rank") <= top)
        .join(kept.select("ordinal", F.col("term").alias("item")), "ordinal")
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )
    return pairs.unionByName(best)


AUDIT_SQL = r"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body,
         row_number() over () as doc
  from documents
), words as (
  select doc, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
  select lang, term from words group by lang, term having count(distinct doc) >= 3
), sizes as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
cells as (
  select w.lang, w.source, w.term, count(*) as n from words w join kept using (lang, term) group by all
), totals as (
  select g.lang, g.source, coalesce(sum(n), 0) as total from groups g left join cells using (lang, source) group by all
), dense as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
         1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (t.total + s.v)::hugeint as p
  from totals t join kept k using (lang) join sizes s using (lang) left join cells c using (lang, source, term)
), of_lang as (
  select lang, term, 1 + 1000000000::hugeint * (n + 1) // (sum(n) over (partition by lang) + s.v)::hugeint as q
  from (select lang, term, sum(n) as n from cells group by all) join sizes s using (lang)
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(s.value, 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select d.lang, d.source, 'term' as part, d.term as item, cast((d.p - q) * (d.p - q) // q as bigint) as value
  from dense d join of_lang using (lang, term) where d.n > 0 and d.p > q
)
select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank
from (from pairs union all from terms) qualify part = 'pair' or rank <= 200
"""

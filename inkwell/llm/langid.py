"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import text_batches, unit_hash

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


@dataclass(frozen=True)
class LanguageModel:
    """``dictionaries``: (language, raw content), the language with most training rows first."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 6
    chunk: int = 4096
    min_margin: float = 0.005
    min_bytes: int = 200
    languages: int = 0


def letters(text: str) -> str:
    """Lower-cased text with every run of other characters as one space."""
    return _NOT_LETTERS.sub(" ", text.lower())


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 400,
    chars_per_row: int = 2000,
    dictionary_bytes: int = 64 * 1024,
    min_ratio: float = 0.3,
    max_languages: int = 200,
    skip: int = 0,
    **options,
) -> LanguageModel:
    """Fit a dictionary per non-null language on a bounded sample of the labelled rows.

    A model holds the ``max_languages`` languages with most rows after the first ``skip`` ones; ``fit_all``
    gives as many models as it takes for all languages.

    Bounds (they hold for fitting only): the ``rows_per_language`` rows with the smallest hash of
    their id, at most ``chars_per_row`` characters of each and ``dictionary_bytes`` a language. Sampled texts that compress below
    ``min_ratio`` repeat themselves and teach nothing; they are used only where nothing else is.
    Rows are picked by a bound on their hash that a language's count gives, with half as many to
    spare, so no task ranks more than those, whatever share of the rows a language has, and the
    sample has at most ``max_languages * rows_per_language`` rows. Null texts, languages and ids
    don't teach; without any labelled row the model is empty and predicts ``und``.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").offset(skip).limit(max_languages).collect()
    share = [x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, (1.5 * rows_per_language + 50) / n)))]
    draw = unit_hash(1, F.col(id_col))
    own = F.create_map(*share)[F.col(lang_col)] if share else F.lit(0.0)
    some = rows.where(draw < own).select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), draw.alias("_draw"), F.substring(text_col, 1, chars_per_row).alias("text"))
    rank = Window.partitionBy("_lang").orderBy("_draw", "_id", "text")
    sample = some.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= rows_per_language).select("_lang", "_r", "text")
    texts: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(sample.toLocalIterator(), key=lambda r: (r[0], r[1], r[2])):
        texts.setdefault(lang, []).append(letters(text).encode())
    plain = zstandard.ZstdCompressor(level=3)
    out = []
    for lang, _ in counts:
        good = [t for t in texts.get(lang, []) if len(plain.compress(t)) >= min_ratio * len(t)] or texts.get(lang, [])
        content = b" ".join(dict.fromkeys(good))[:dictionary_bytes]
        if len(content) >= 8:
            out.append((lang, content))
    return LanguageModel(tuple(out), languages=len(counts), **options)


def fit_all(labelled: DataFrame, *cols: str, max_languages: int = 200, **how) -> Iterator[LanguageModel]:
    """Models of all languages, ``max_languages`` at a time, those with most rows first; one model at least.

    One is fitted when the one before it has been used, so the driver holds one at a time.
    """
    skip = 0
    while True:
        model = fit(labelled, *cols, max_languages=max_languages, skip=skip, **how)
        if model.languages or not skip:
            yield model
        if model.languages < max_languages:
            return
        skip += max_languages


def narrow(best: int, second: int, n_bytes: int, model: LanguageModel) -> bool:
    """Whether the two best sizes of a text are too near to tell its language: equal, or under
    ``min_margin`` apart where the text has ``min_bytes`` bytes of letters or more."""
    return second == best or (n_bytes >= model.min_bytes and second - best < model.min_margin * second)


def make_classifier(model: LanguageModel):
    """A function (text, held) -> (language, score, margin in share of the second size, rejected, best
    size, second size). ``held`` is (language, best size, second size) of the models before, if any."""
    coders = []
    for lang, content in model.dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=model.level)
        coders.append((lang, zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False)))

    def classify(text: str | None, held: tuple[str | None, int | None, int | None] = (None, None, None)) -> tuple:
        data = letters(text or "").strip()
        if not data or not coders and held[0] is None:
            return "und", 0.0, 0.0, True, None, None
        data = data.encode()
        chunks = [data[i : i + model.chunk] for i in range(0, len(data), model.chunk)]
        lang, best, second = held
        for own, coder in coders:
            size = sum(len(coder.compress(x)) for x in chunks)
            if best is None or size < best:  # a tie goes to the language with more training rows
                lang, best, second = own, size, best
            elif second is None or size < second:
                second = size
        if second is None:
            return lang, 1.0, 1.0, False, best, None
        margin = (second - best) / second
        # bytes saved a chunk over the second language, on a 0 to 1 scale: an odds of 2 for a byte
        score = 1 / (1 + 2.0 ** -min(60.0, (second - best) / len(chunks)))
        return lang, score, margin, narrow(best, second, len(data), model), best, second

    return classify


_TYPES = {"lang": pa.string(), "score": pa.float64(), "margin": pa.float64(), "rejected": pa.bool_(), "best": pa.int64(), "second": pa.int64()}


def predict(docs: DataFrame, models: LanguageModel | Iterable[LanguageModel], text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``langid``: ``lang``, ``score``, ``margin``, ``rejected`` and the two sizes.

    Every whole text is compressed, in chunks, with each dictionary; the smallest sum wins. Null
    texts and texts without a letter give ``und``, score 0, rejected. A text whose two best sizes are
    equal is rejected, and one of ``min_bytes`` letters or more whose two best sizes differ by under
    ``min_margin``; shorter ones are too short to ask for a margin. Models are narrow maps one
    after the other, each going on from the sizes before; other columns pass through, and one
    named ``langid`` is replaced.
    """
    keep = [c for c in docs.columns if c != "langid"]
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text_col)
    schema = out.withColumn("langid", F.lit(None).cast("struct<lang:string,score:double,margin:double,rejected:boolean,best:bigint,second:bigint>")).schema

    def mapped(model: LanguageModel):
        def run(batches):
            classify = make_classifier(model)
            for b in batches:
                texts = b.column(at).to_pylist()
                held = [(r["lang"] if r["best"] is not None else None, r["best"], r["second"]) for r in b.column(len(keep)).to_pylist()] if b.num_columns > len(keep) else [(None, None, None)] * len(texts)
                found = list(zip(*map(classify, texts, held))) or [[]] * len(_TYPES)
                arrays = [pa.array(v, type=t) for v, t in zip(found, _TYPES.values())]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.StructArray.from_arrays(arrays, list(_TYPES))], names=[*keep, "langid"])

        return run

    out = text_batches(out)
    for model in [models] if isinstance(models, LanguageModel) else models:
        out = out.mapInArrow(mapped(model), schema)
    return out


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit_options) -> DataFrame:
    """Fit on the rows that are not held out, predict all: ``docs`` with ``held_out`` and ``langid``.

    A null id is not held out and doesn't teach.
    """
    models = fit_all(docs.where(fold(id_col) != 0), id_col, text_col, lang_col, **fit_options)
    return predict(docs, models, text_col).withColumn("held_out", F.coalesce(fold(id_col) == 0, F.lit(False)))

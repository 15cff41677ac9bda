"""Language identification by compression.

For each language a raw-content zstandard dictionary is put together from a
bounded sample of its training documents, a stretch of each. A text is compressed with every dictionary; the
language whose dictionary leaves the fewest bytes wins. Narrow margins are
rejected: ``accepted`` is false there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: The sample that dictionaries are made of: documents of a language, code points of the stretch that each gives.
SAMPLE_DOCS, STRETCH = 512, 512
#: zstandard's effort; matches of three bytes count, as syllables are short. Chosen on a part of the training fold.
LEVEL, MIN_MATCH = 7, 3
#: The least margin, as a share of the runner-up's bytes, at which the winner is accepted.
MARGIN = 0.01
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, accepted boolean"


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Dictionaries by language, the commonest language first: it wins ties."""

    dictionaries: dict[str, bytes]
    level: int = LEVEL
    min_match: int = MIN_MATCH
    margin: float = MARGIN
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": []}

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        if not self._made:
            for lang, content in self.dictionaries.items():
                how = zstandard.ZstdCompressionParameters.from_level(self.level, min_match=self.min_match, write_content_size=0, write_checksum=0, write_dict_id=0)
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
                self._made.append((lang, zstandard.ZstdCompressor(compression_params=how, **({"dict_data": known} if known else {}))))
        return self._made

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """``lang_pred, score, margin, accepted``."""
        if not text or not self.dictionaries or not has_letter(text):
            return UNKNOWN, 0.0, 0.0, False
        raw = folded(text)
        sizes = [len(c.compress(raw)) for _, c in self.compressors()]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        # A saved byte makes a language twice as likely: bits of code are not independent evidence.
        score = 1.0 / (1.0 + sum(2.0 ** -min(s - sizes[best], 1000) for s in rest))
        return self.compressors()[best][0], score, margin, margin >= self.margin


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, stretch: int = STRETCH) -> LanguageModel:
    """Dictionaries from the rows whose crc32(doc_id as text) mod 3 is not 1 and whose ``lang`` and ``text`` are there.

    The counts of languages cover all these rows. The sample is of the first
    ``sample_docs`` rows of each language in the order of a hash of ``doc_id``,
    and every one of them gives ``stretch`` code points, or all that it has, from
    a place that hangs on the hash. Two jobs find it whatever the size of the
    table; the driver gets one and a half times the sample at most, and a row
    per language. Of a language with very many rows of few ids fewer may come.
    """
    known = docs.filter((crc_fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return LanguageModel({})
    hashed = F.xxhash64(F.col("doc_id"), F.lit("language"))
    at = hashed / F.lit(float(1 << 64)) + F.lit(0.5)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (1.5 * sample_docs + 64) / n)])
    begin = F.pmod(F.xxhash64(hashed), F.greatest(F.length("text") - F.lit(stretch - 1), F.lit(1))).cast("int") + 1
    near = known.select("lang", at.alias("x_at"), F.col("text").substr(begin, F.lit(stretch)).alias("x_part")).filter(F.col("x_at") < share[F.col("lang")])
    # The share makes about this many rows; the limit holds even if ids repeat.
    rows = near.orderBy(F.col("x_at") / share[F.col("lang")], "lang", "x_part").limit(len(counts) * (2 * sample_docs + 64)).collect()
    drawn: dict[str, list[str]] = {k: [] for k in counts}
    for lang, _, part in rows:
        if len(drawn[lang]) < sample_docs:
            drawn[lang].append(part)
    return LanguageModel({k: b"\n".join(map(folded, v)) for k, v in drawn.items()})


def identify_languages(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score, margin, accepted``.

    Only the whole text is an input of a prediction. Text that is null or has no
    letter, and any text where no language was learned, gives ``und`` with score 0.
    Ties go to the commoner language. A null ``doc_id`` is never trained on nor
    held out. Repeated rows and other columns don't matter.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.classify(t.as_py()) for t in batch.column(2)]
            lang, score, margin, accepted = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(accepted, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "accepted"],
            )

    held_out = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(judge, SCHEMA)

"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts.  A text is compressed
whole, piece by piece, with every dictionary; the language whose dictionary makes it smallest is predicted, and the
prediction is rejected if the runner-up is nearly as small.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window

from binloom.llm import tables
from binloom.llm.words import column, slices

SAMPLE_ROWS = 128       # texts of each language that a dictionary is made from
SAMPLE_CHARS = 1024     # of each of them
LEVEL = 6
PIECE = 4096            # bytes compressed at a time, so that the dictionary serves the whole of a long text
MARGIN = 0.005          # least lead over the runner-up, as a share of its size
MAX_LANGUAGES = 1000    # bound of what is broadcast, with the sample's
UNKNOWN = "und"
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normal(text: str) -> bytes:
    """Lower-cased letters and single spaces; signs and digits tell little about a language."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS,
          chars: int = SAMPLE_CHARS) -> tuple[list[str], list[bytes]]:
    """Languages, most frequent first, and their dictionaries.

    Each language's rows are thinned by a hash to a few times ``rows`` before any are ranked, so no language is gathered
    whole.  Rows with a null text or language teach nothing.
    """
    own = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"),
                      F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * rows / n + 20 / n)))])
    place = (F.shiftrightunsigned(F.xxhash64("h"), 11) / F.lit(float(1 << 53))) < F.element_at(share, F.col("lang"))
    at = F.pmod("h", F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    some = own.where(place).select("lang", "h", F.substring("text", at.cast("int"), F.lit(chars)).alias("text"))
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= rows)
    sample: dict[str, list] = {k: [] for k in counts}
    for row in ranked.orderBy("lang", "r").collect():
        sample[row.lang].append(normal(row.text))
    return list(counts), [b" ".join(sample[k]) or b" " * 8 for k in counts]


class Classifier:
    def __init__(self, languages: list[str], dictionaries: list[bytes], level: int = LEVEL):
        self.languages, self.coders = languages, []
        for raw in dictionaries:
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=False,
                                                        write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i:i + PIECE] for i in range(0, max(1, len(text)), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and lead.  Equal sizes go to the language with more labelled texts.

        The score is the best one's share if each byte more halves a language's chances: 1 / languages at a tie of all, near
        1 at a clear lead.
        """
        plain = normal(text) if text else b""
        if not self.languages or not any(c.isalpha() for c in plain.decode()):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(plain)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        score = 1.0 / math.fsum(0.5 ** min(s - sizes[best], 1000) for s in sizes)
        return self.languages[best], score, (rest - sizes[best]) / rest


@tables.names_apart
def identify(docs: DataFrame, languages: list[str], dictionaries: list[bytes], *, text: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """The documents with ``__lang`` (``und`` if the text is null or has no letters), ``__score`` and ``__rejected``.

    Every text is encoded whole.  Rejected are leads under ``margin`` and texts without a language.  Without any labelled text
    all are ``und``; repeated rows get equal results; an empty table gives an empty one; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast((languages, dictionaries))
    schema = docs.withColumns({"__lang": F.lit(""), "__score": F.lit(0.0), "__rejected": F.lit(True)}).schema
    names = schema.names

    def run(batches):
        judge = Classifier(*shared.value)
        for batch in slices(batches, text):
            got = [judge.classify(t.as_py()) for t in column(batch, text)]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                   pa.array([g[0] == UNKNOWN or g[2] < margin for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = tables.fold("doc_id", 4) == 2
    learned = learn(docs.where(~held))
    out = identify(docs.select("doc_id", "text"), *learned)
    return out.select("doc_id", held.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"),
                      F.col("__rejected").alias("rejected"))

"""Vector linking: catalog with vectors, ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.catalog import build_catalog
from termloom.operators.encode import add_ngrams, encode_ngrams
from termloom.operators.evaluate import evaluate_by_mention, evaluate_hits_and_mrr, fan_out
from termloom.operators.search import CatalogIndex, Encoder, search, search_one
from termloom.session import pinned


def ngram_encoder(dim: int = 64, n: int = 3, max_tokens: int | None = None) -> Encoder:
    """Default encoder: (table, key, text) -> (key, embedding)."""
    return lambda texts, key, text: encode_ngrams(texts, key, text, dim, n, max_tokens)


def vector_catalog(
    mentions: DataFrame,
    rule: str = "mode",
    encoder: Encoder | None = None,
    entity: str = "mondo_id",
) -> DataFrame:
    """(entity_id, rep_text, ordinal, embedding) from a mention table.

    The default encoder adds its column to the catalog; any other is joined by entity.
    """
    catalog = build_catalog(mentions, rule, entity)
    if encoder is None:
        return add_ngrams(catalog, "rep_text")
    return catalog.join(encoder(catalog, "entity_id", "rep_text"), "entity_id")


class VectorLinker:
    """Ranks the entries of a vector catalog for mention texts."""

    def __init__(self, catalog: DataFrame, encoder: Encoder | None = None) -> None:
        self.catalog = catalog
        self.encoder = encoder or ngram_encoder()
        self._index: CatalogIndex | None = None

    def index(self) -> CatalogIndex:
        """The catalog made ready for search, once per linker."""
        if self._index is None:
            self._index = CatalogIndex(self.catalog)
        return self._index

    def close(self) -> None:
        if self._index is not None:
            self._index.close()
            self._index = None

    def encode_mentions(self, rows: DataFrame) -> DataFrame:
        """(mention, embedding) for the distinct mentions of ``rows``."""
        distinct = rows.select("mention").distinct().select("mention", F.col("mention").alias("text"))
        return self.encoder(distinct, "mention", "text")

    def predict_batch(self, rows: DataFrame, top_k: int = 10) -> DataFrame:
        """(mention, entity_id, score, rank), every distinct mention ranked once."""
        # Counted to size the blocks, then searched: encode once.
        vectors = pinned(self.encode_mentions(rows), "vectors")
        hits = self.index().search(vectors, top_k, query="mention")
        return hits.withColumnRenamed("query_id", "mention")

    def predict_rows(self, rows: DataFrame, top_k: int = 10) -> DataFrame:
        """Hits for every row of ``rows``, equal mentions sharing one result."""
        return fan_out(rows, self.predict_batch(rows, top_k))

    def search(self, mention: str, top_k: int = 10) -> DataFrame:
        """Hits of one mention text, without shuffling the catalog."""
        row = self.catalog.sparkSession.createDataFrame([(mention,)], "mention string")
        vector = self.encode_mentions(row).first()["embedding"]
        return search_one(self.catalog, vector, top_k)

    def evaluate(self, rows: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
        """Hits@K and MRR over rows of (mention, mondo_id)."""
        truth = rows.select("mention", F.col("mondo_id").alias("entity_id"))
        return evaluate_by_mention(truth, self.predict_batch(rows, max(ks)), ks)


def evaluate_vectors(
    queries: DataFrame,
    catalog: DataFrame,
    truth: DataFrame,
    k: int = 10,
    ks: tuple[int, ...] = (1, 3, 5, 10),
) -> DataFrame:
    """Search given vectors and evaluate; ``truth`` is (query_id, entity_id)."""
    return evaluate_hits_and_mrr(truth, search(queries, catalog, k), ks)

"""Chains of steps over one table, and one object for the questions asked of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.backends import ALIGNMENTS, embed_texts, quantify
from tessera.operators import graph as G
from tessera.operators import similarity as S


class Pipeline:
    """Steps one after the other: ``Pipeline(df).embed("text").quantify("text", ["plain"]).result``."""

    def __init__(self, df: DataFrame, id_col: str = "id"):
        self.result, self.id_col = df, id_col

    def _with(self, df: DataFrame) -> Pipeline:
        return Pipeline(df, self.id_col)

    def step(self, f: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return self._with(f(self.result))

    def embed(self, text: str, into: str = "embedding", model: str = "hashing", **options) -> Pipeline:
        return self._with(embed_texts(self.result, text, into, model, **options))

    def quantify(self, text: str, kinds: list[str]) -> Pipeline:
        return self._with(quantify(self.result, text, kinds))

    def search(self, queries: DataFrame, vec: str = "embedding", k: int = 10) -> Pipeline:
        """(query_id, other_id, similarity) of the rows most like the queries; ids are numbers."""
        return self._with(S.search(queries, self.result, self.id_col, vec, k=k))

    def compare(self, pairs: DataFrame, method: str) -> Pipeline:
        """Pairs (a, b) scored by a registered alignment, a function of pairs and this table."""
        return self._with(ALIGNMENTS.get(method)(pairs, self.result))


class Knowledge:
    """Nodes and edges with the questions asked of them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def _one(self, uid: str) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(uid,)], "uid string")

    def node(self, uid: str) -> DataFrame:
        return self.nodes.where(F.col("uid") == uid)

    def of_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type)

    def edges_of(self, src: str | None = None, dst: str | None = None, types: list[str] | None = None) -> DataFrame:
        return G.filter_edges(self.edges, src, dst, types)

    def neighbours(self, uid: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
        return G.neighbours(self.edges, self._one(uid), direction, types)

    def influence(self, uid: str, depth: int = 2, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        return G.influence_network(self.edges, self._one(uid), depth, direction)

    def paths(self, src: str, dst: str, max_depth: int = 6) -> DataFrame:
        """Simple paths, the shortest first."""
        return G.simple_paths(self.edges, self._one(src), self._one(dst), max_depth).orderBy("hops", "path")

    def cluster(self, uid: str, depth: int = 2) -> DataFrame:
        return G.concept_cluster(self.edges, self._one(uid), depth)

    def summary(self) -> DataFrame:
        return G.graph_summary(self.nodes, self.edges)

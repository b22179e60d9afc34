"""From a syntax tree to one Spark plan.

A query is one pass over the postings of its terms: filter by term, score each posting, aggregate by
document to the sum of scores and one flag a term, keep the documents whose flags satisfy the tree, and
take the best. All matched terms of the query add to the score, those on a NOT side or in a branch that
doesn't hold included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millstone.errors import InvalidError
from millstone.operators.ranking import algorithm
from millstone.plans.query_lang import Leaf, Node

LIMIT = 1000
MAX_LIMIT = 2**32 - 1
RESULT = "doc_id long, score double"


def condition(tree: Node | Leaf, has: dict[str, Column]) -> Column:
    """The tree as a boolean column; a value without a column is in no document. Chains of one operator stay flat."""
    if isinstance(tree, Leaf):
        return has.get(tree.value, F.lit(False))
    if tree.op == "NOT":
        return condition(tree.left, has) & ~condition(tree.right, has)
    parts, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, Node) and node.op == tree.op:
            todo += [node.right, node.left]
        else:
            parts.append(condition(node, has))
    both = tree.op == "AND"
    while len(parts) > 1:  # a balanced tree keeps the optimizer's recursion shallow
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [reduce(lambda a, b: a & b if both else a | b, p) for p in pairs]
    return parts[0]


def check_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 0 < limit <= MAX_LIMIT:
        raise InvalidError("invalid limit")
    return min(limit, 2**31 - 1)


def top(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc_id").limit(check_limit(limit))


def ranked(postings: DataFrame, tree: Node | Leaf, term_of: dict[str, str], tokens: list[str], df: dict[str, int], docs: int, words: int, algo: str, limit: int) -> DataFrame:
    """(doc_id, score) of the best documents.

    ``term_of`` maps query values to index terms; ``tokens`` are the terms of the query's distinct
    tokens, so two tokens that were resolved to one term score twice.
    """
    check_limit(limit)
    rank = algorithm(algo)
    terms = sorted(set(tokens))
    if not terms:
        return postings.sparkSession.createDataFrame([], RESULT)
    per = lambda values: F.create_map(*[F.lit(x) for t in terms for x in (t, values[t])])[F.col("term")]
    score = rank(F.col("tf"), F.col("doc_len"), per({t: float(df.get(t, 0)) for t in terms}), F.lit(float(docs)), F.lit(float(words)))
    flags = {t: f"has_{i}" for i, t in enumerate(terms)}
    found = (
        postings.where(F.col("term").isin(terms))
        .select("doc_id", "term", (score * per({t: float(tokens.count(t)) for t in terms})).alias("score"))
        .groupBy("doc_id")
        .agg(F.sum(F.when(F.col("score") >= 0, F.col("score"))).alias("score"), *[F.bool_or(F.col("term") == t).alias(c) for t, c in flags.items()])
    )
    has = {v: F.col(flags[t]) for v, t in term_of.items()}
    return top(found.where(condition(tree, has) & F.col("score").isNotNull()).select("doc_id", "score"), limit)

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millstone.errors import InvalidError, LimitError
from millstone.plans.query_lang import Leaf, Node, leaves, lex, parse


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("A", "`A`"),
        ("(A OR B) AND C", "(AND (OR `A` `B`) `C`)"),
        ("A OR (B AND C)", "(OR `A` (AND `B` `C`))"),
        ("A OR B AND C", "(OR `A` (AND `B` `C`))"),
        ("A and not B", "(NOT `A` `B`)"),
        ("A\nand\nB", "(AND `A` `B`)"),
        ("a b AND c", "(OR `a` (AND `b` `c`))"),
        ("a&b -foo android", "(OR (OR `a&b` `-foo`) `android`)"),
        ("a & b | c", "(OR (AND `a` `b`) `c`)"),
        ('"x"y', '`"x"y`'),
        ('"abc', '`"abc`'),
        ("((a))", "`a`"),
        ("((a AND b) OR c) AND d", "(AND (OR (AND `a` `b`) `c`) `d`)"),
        ("a AND NOT b AND c", "(AND (NOT `a` `b`) `c`)"),
        (
            " \"sp ace\" OR 'quo\\'te' OR ąžuolas OR 🇬🇧🇺🇸 AND Київ OR (1 AND NOT (  2   OR   3 ))",
            "(OR (OR (OR (OR `sp ace` `quo\\'te`) `ąžuolas`) (AND `🇬🇧🇺🇸` `Київ`)) (NOT `1` (OR `2` `3`)))",
        ),
    ],
)
def test_trees(query, tree):
    assert str(parse(query)) == tree


@pytest.mark.parametrize("query", ["a AND", "a b OR (c OR d) AND (e", "(a b)", "NOT a", "a OR NOT b", "", "  ", ")", "()"])
def test_errors(query):
    with pytest.raises(InvalidError, match="syntax error near"):
        parse(query)


def test_nesting_limit():
    parse(" AND ".join(["a"] * 101))
    with pytest.raises(LimitError):
        parse(" AND ".join(["a"] * 102))


def test_nul_ends_the_query():
    assert str(parse("a\x00 AND")) == "`a`"


trees = st.recursive(st.builds(Leaf, st.sampled_from(["a", "b", "x1", "-y"])), lambda c: st.builds(Node, st.sampled_from(["AND", "OR", "NOT"]), c, c), max_leaves=12)


def written(t):
    if isinstance(t, Leaf):
        return t.value
    return f"({written(t.left)} {'AND NOT' if t.op == 'NOT' else t.op} {written(t.right)})"


@given(trees)
@settings(max_examples=60, deadline=None)
def test_parse_reads_back_what_is_written(tree):
    assert parse(written(tree)) == tree
    assert [t.value for t in lex(written(tree)) if t.kind == "VALUE"] == leaves(tree)

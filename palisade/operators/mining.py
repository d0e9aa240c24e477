"""Template mining: masks, Drain clustering of distinct masked lines, template matching."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fx
from palisade.functions.text import fenced, lit, strip
from palisade.plans.checkpoints import tabled


def mask_line(column: str) -> str:
    """The line with IPs, ids, times, quoted text and numbers replaced by placeholders."""
    masked = strip(column)
    for name, pattern in fx.LINE_MASKS:
        masked = f"regexp_replace({masked}, {lit(pattern)}, '<{name}>')"
    return masked


class Tree:
    """Drain clusters of lines with one token count; the first token picks the child node.

    A line may itself be a template; its wildcards agree with nothing. A template of several lines keeps enough tokens to be
    joined by its like, and two templates of one tree never join each other later on.

    Only a cluster that shares enough tokens with a line can take it. Such a cluster holds at least one of any n - need + 1
    of the line's n tokens, so the rarest of them, in an index by place and token, name all candidates.
    """

    def __init__(self, max_children: int = fx.DRAIN_MAX_CHILDREN, similarity: float = fx.DRAIN_SIMILARITY):
        self.max_children = max_children
        self.similarity = similarity
        self.children: dict[str, set[int]] = {}
        self.templates: list[list[str]] = []
        self.holders: dict[tuple[int, str], list[int]] = {}

    def _candidates(self, tokens: list[str], known: set[int]) -> list[int]:
        need = max(1, ceil(self.similarity * len(tokens) - 1e-9))
        if self.similarity <= 0 or not tokens:
            return sorted(known)
        posts = sorted((self.holders.get(key, ()) for key in enumerate(tokens) if key[1] != fx.WILDCARD), key=len)
        return sorted({i for post in posts[: max(0, len(posts) - need + 1)] for i in post if i in known})

    def add(self, tokens: list[str]) -> int:
        """Join the most similar cluster of the child (more wildcards win a tie) or open a new one.

        A first token without a child of its own is looked for under the wildcard child.
        """
        head = tokens[0] if tokens else ""
        known = self.children.get(head, self.children.get(fx.WILDCARD, set()))
        best, best_key = -1, (-1.0, -1)
        for i in self._candidates(tokens, known):
            template = self.templates[i]
            same = sum(a == b for a, b in zip(template, tokens) if a != fx.WILDCARD)
            key = (same / len(tokens) if tokens else 1.0, template.count(fx.WILDCARD))
            if key > best_key:
                best, best_key = i, key
        if best >= 0 and best_key[0] >= self.similarity:
            self.templates[best] = [
                a if a == b else fx.WILDCARD for a, b in zip(self.templates[best], tokens)]
            return best
        return self.open(tokens)

    def open(self, tokens: list[str]) -> int:
        """A new cluster, whatever the others hold."""
        head = tokens[0] if tokens else ""
        number = len(self.templates)
        self.templates.append(list(tokens))
        for key in enumerate(tokens):
            self.holders.setdefault(key, []).append(number)
        self.children.setdefault(self._child_for(head), set()).add(number)
        return number

    def _child_for(self, head: str) -> str:
        """Child of a new cluster: tokens with digits, and those beyond the children bound, share one."""
        if head in self.children:
            return head
        room = self.max_children if fx.WILDCARD in self.children else self.max_children - 1
        return fx.WILDCARD if any(c.isdigit() for c in head) or len(self.children) >= room else head


#: Distinct masked lines of one slice of a leaf. Up to so many, a leaf is clustered line by line.
SLICE_LINES = 4096

_CLUSTERED = "leaf string, slice int, cluster long, line string, template string"


def _clusters(max_children: int):
    """Lines in the order of leaf, slice and first sight: one row per line with its cluster, and one per cluster when a slice ends.

    A task holds the templates of one slice, never its lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree = None, Tree(max_children)

        def ended() -> pa.RecordBatch:
            n = len(tree.templates)
            return _clustered([current[0]] * n, [current[1]] * n, list(range(n)), [None] * n, [" ".join(t) for t in tree.templates])

        for batch in batches:
            leaves, slices, lines = (c.to_pylist() for c in batch.columns)
            numbers: list[int] = []
            for own, line in zip(zip(leaves, slices), lines):
                if own != current:
                    if tree.templates:
                        yield ended()
                    current, tree = own, Tree(max_children)
                numbers.append(tree.add(line.split()))
            yield _clustered(leaves, slices, numbers, lines, [None] * len(lines))
        if tree.templates:
            yield ended()

    return run


def _clustered(leaves: list, slices: list, numbers: list, lines: list, templates: list) -> pa.RecordBatch:
    columns = (pa.array(leaves, pa.string()), pa.array(slices, pa.int32()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string()),
               pa.array(templates, pa.string()))
    return pa.RecordBatch.from_arrays(list(columns), names=["leaf", "slice", "cluster", "line", "template"])


def _generalised(rows: DataFrame, max_children: int) -> DataFrame:
    """(leaf, slice, line, seen), clustered slice by slice in the order seen: leaf, slice, line, template, seen."""
    ordered = rows.repartition("leaf", "slice").sortWithinPartitions("leaf", "slice", "seen", "line").select("leaf", "slice", "line")
    found = tabled(ordered.mapInArrow(_clusters(max_children), _CLUSTERED))
    ended = found.filter("line is null").select("leaf", "slice", "cluster", "template")
    return found.filter("line is not null").drop("template").join(ended, ["leaf", "slice", "cluster"]).join(
        rows.select("leaf", "line", "seen"), ["leaf", "line"]).select("leaf", "slice", "line", "template", "seen")


def distinct_masked(lines: DataFrame, payload: str = "raw_payload", order: str = "ingest_ts") -> DataFrame:
    """masked, lines, first_seen, sample: what clustering works on, however many lines there are."""
    return lines.selectExpr(f"{mask_line(payload)} as masked", f"{strip(payload)} as line", f"{order} as seen").groupBy(
        "masked").agg(
        F.count("*").alias("lines"), F.min("seen").alias("first_seen"), F.min_by("line", F.struct("seen", "line")).alias("sample"))


def _with_leaf(masked: DataFrame, max_children: int) -> DataFrame:
    """Group of lines that can meet in the tree.

    Without a wildcard child, lines meet only under the same token count and first token.
    Where a token count has one (a first token with a digit, or too many first tokens), its
    lines can meet there and stay together.
    """
    blanks = lit(r"\s+")
    split = masked.selectExpr(
        "*", f"size(split(masked, {blanks})) as token_count", f"get(split(masked, {blanks}), 0) as head")
    shared = split.groupBy("token_count", "head").count().groupBy("token_count").agg(
        F.expr(f"bool_or(head rlike '[0-9]') or count(*) >= {max_children}").alias("shared"))
    return split.join(shared, "token_count").selectExpr(
        "masked", "lines", "first_seen", "sample",
        "if(shared, cast(token_count as string), concat(token_count, ' ', head)) as leaf")


def mine_templates(
    lines: DataFrame,
    payload: str = "raw_payload",
    order: str = "ingest_ts",
    max_children: int = fx.DRAIN_MAX_CHILDREN,
) -> tuple[DataFrame, DataFrame]:
    """Templates and the assignment of masked lines to them.

    Templates: template_id (first-seen rank), template, size, sample. Assignment: masked,
    template. Lines are reduced to distinct masked lines first; groups that cannot meet in the
    tree are clustered on their own, each in first-seen order. A group of more than SLICE_LINES
    distinct lines is dealt into slices: each gives partial templates, and these are clustered
    in turn, so that the step that sees all of a group sees templates, not lines.
    """
    # The distinct lines are cut off here: filters of the next steps must not reach the raw lines.
    masked = _with_leaf(tabled(distinct_masked(lines, payload, order)), max_children)
    slices = masked.groupBy("leaf").agg(F.expr(f"cast(ceil(count(*) / {SLICE_LINES}D) as int)").alias("slices"))
    dealt = masked.join(slices, "leaf").selectExpr(
        "leaf", "cast(pmod(xxhash64(masked), slices) as int) as slice", "masked as line", "first_seen as seen")
    partial = tabled(_generalised(dealt, max_children).join(slices, "leaf"))
    once = partial.filter("slices > 1").groupBy("leaf", "template").agg(F.min("seen").alias("seen"))
    whole = _generalised(once.selectExpr("leaf", "0 as slice", "template as line", "seen"), max_children)
    several = partial.filter("slices > 1").selectExpr("leaf", "line as masked", "template as part").join(
        whole.selectExpr("leaf", "line as part", "template"), ["leaf", "part"])
    assigned = tabled(several.select("masked", "template").union(
        partial.filter("slices = 1").selectExpr("line as masked", "template")))
    found = masked.join(assigned, "masked").groupBy("template").agg(
        F.sum("lines").alias("size"), F.min("first_seen").alias("first_seen"),
        F.min_by("sample", F.struct("first_seen", "sample")).alias("sample"))
    # Ranking all templates needs one ordered run over them; templates are few by nature.
    ids = found.selectExpr(
        "cast(row_number() over (order by first_seen, template) as int) as template_id",
        "template", "size", "sample", "first_seen")
    return ids, assigned


def template_postings(templates: DataFrame) -> DataFrame:
    """Each template under one key, the rarest of its fixed tokens: token_count, at, token, and what a check needs.

    A line that a template fits holds all its fixed tokens, so also the one that fewest templates hold there. A template of
    wildcards alone stands under its number of tokens.
    """
    blanks = lit(r"\s+")
    split = templates.selectExpr("template_id", "template", f"split(template, {blanks}) as t").selectExpr(
        "template_id", "template", "size(t) as token_count", "size(filter(t, x -> x = '<*>')) as wild",
        "filter(transform(t, (x, i) -> struct(i as at, x as token)), f -> f.token != '<*>') as fixed")
    posted = split.selectExpr("template_id", "token_count", "inline_outer(fixed)")
    rarity = posted.groupBy("token_count", "at", "token").agg(F.count("*").alias("holders"))
    rarest = posted.filter("at is not null").join(rarity, ["token_count", "at", "token"]).groupBy("template_id").agg(
        F.min(F.struct("holders", "at", "token")).alias("key"))
    return split.join(rarest, "template_id", "left").selectExpr(
        "token_count", "coalesce(key.at, -1) as at", "coalesce(key.token, '') as token", "template_id", "template", "wild", "fixed")


def match_template(lines: DataFrame, templates: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """template_id, template and parameter list of each line, null when no template fits.

    Distinct masked lines meet templates on the template's rarest token, see ``template_postings``; of the
    fitting templates the one with the fewest wildcards, then the smallest id, wins.
    """
    blanks = lit(r"\s+")
    rows = lines.selectExpr("*", f"{mask_line(payload)} as masked")
    distinct = rows.select("masked").distinct().selectExpr("masked", f"split(masked, {blanks}) as m")
    keyed = distinct.selectExpr(
        "masked", "m", "size(m) as token_count",
        "inline(concat(array(struct(-1 as at, '' as token)), transform(m, (x, i) -> struct(i as at, x as token))))")
    hits = keyed.join(template_postings(templates), ["token_count", "at", "token"]).filter("forall(fixed, f -> m[f.at] = f.token)")
    best = hits.groupBy("masked").agg(
        F.min(F.struct("wild", "template_id", "template")).alias("b")).selectExpr(
        "masked", "b.template_id as template_id", "b.template as template")
    out = rows.join(_with_pattern(best), "masked", "left")
    return _with_parameters(out, payload)


def _with_pattern(best: DataFrame) -> DataFrame:
    """The pattern made from each template, and how many placeholders it has: once per distinct masked line."""
    quoted = "regexp_replace(template, '([\\\\\\\\\\\\[\\\\](){}.*+?^$|])', '\\\\\\\\$1')"
    pattern = (
        f"concat('^', regexp_replace(replace({quoted}, '<\\\\*>', '(\\\\S+)'), '<[A-Z]+>', '(.+?)'), '$')")
    return fenced(best, {
        "_pattern": pattern, "_count": "size(regexp_extract_all(template, '<(?:[*]|[A-Z]+)>', 0))"}, best.columns)


def _with_parameters(rows: DataFrame, payload: str) -> DataFrame:
    """Text of the line under each placeholder. Lines of a template come one after the other, so its pattern is compiled once a task."""
    values = (
        f"case when template is not null and _count > 0 then transform(sequence(1, _count),"
        f" i -> regexp_extract({strip(payload)}, _pattern, i)) when template is not null"
        " then cast(array() as array<string>) end")
    return rows.sortWithinPartitions("_pattern").selectExpr("*", f"{values} as parameters").drop("_pattern", "_count")

"""URL filtering by pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path + rest`` of a URL together with the
literal tokens that every URL it can match must hold. It is filed under that
token which the fewest URLs hold. A URL's tokens fetch the rules filed under them, and
only those run. The rule set is a parameter of bounded size; URLs never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import lower_ascii, prepare

MOST_RULES = 100_000
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``label`` decides ``verdict`` where ``pattern`` is found; the longest label wins, exact ones first."""

    label: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    exact: bool


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains whose paths start with ``path``."""
    literal = re.escape(host) + " " + re.escape(path)
    # Tokens at the open end of the path may go on in the URL, so they are no keys.
    whole = TOKEN.findall(host) + TOKEN.findall(path[: path.rfind("/") + 1].lower())
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{literal}", tuple(whole), True)


def word_rule(words: str, verdict: str = "block") -> Rule:
    """A rule for URLs in which the dash-joined ``words`` stand as whole tokens, in this order, without anything else between."""
    parts = words.split("-")
    return Rule(words, verdict, r"(?<![a-z0-9])" + r"[-_.]".join(map(re.escape, parts)) + r"(?![a-z0-9])", tuple(parts), False)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower ASCII case and path; both empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    before = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(before, r"^([^/]*)", 1)
    path = F.substring(before, F.length(host) + 1, F.length(before))
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(subject: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many rows of ``subject(text)`` hold each wanted token; as many rows as tokens wanted, at most."""
    if not wanted:
        return {}
    tokens = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")))
    counts = subject.select(tokens.alias("token")).where(F.col("token").isin(sorted(wanted))).groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.toPandas().to_dict("records")}


def filing(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; those without any token under the empty one."""
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        filed.setdefault(key, []).append(rule)
    return filed


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict, method_rule, tested`` for each row of ``pages``.

    ``rule`` is the label of the longest exact rule that fits, else null. The verdict is
    that rule's, else that of the longest other rule (``method_rule``), else ``default``.
    Labels tie in their order. ``tested`` counts the expressions that were run. A null URL or one without ``://``
    has an empty host and path and no rule. Repeated rows are judged each.
    """
    assert len(rules) <= MOST_RULES, "too many rules to send to every worker"
    prepare(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).select("key", host.alias("host"), path.alias("path"), "url")
    tail = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3 + length(host) + length(path), length(url))")).otherwise(F.lit(""))
    rows = rows.select("key", "host", "path", F.coalesce(tail, F.lit("")).alias("rest"))
    counts = token_counts(rows.select(F.concat_ws(" ", "host", "path", "rest").alias("text")), {t for r in rules for t in r.tokens})
    filed = filing(rules, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {t: [(r, re.compile(r.pattern)) for r in group] for t, group in filed.items()}
        always = own.get("", [])
        for batch in batches:
            out = []
            for host, path, rest in zip(*(batch.column(n).to_pylist() for n in ("host", "path", "rest"))):
                exact_subject = f"{host} {path}"
                loose_subject = f"{host} {path}{rest}".lower()
                best: dict[bool, Rule] = {}
                tested = 0
                for rule, pattern in [*always, *(x for t in set(TOKEN.findall(loose_subject)) for x in own.get(t, ()))]:
                    tested += 1
                    if pattern.search(exact_subject if rule.exact else loose_subject):
                        held = best.get(rule.exact)
                        if held is None or (-len(rule.label), rule.label) < (-len(held.label), held.label):
                            best[rule.exact] = rule
                exact, loose = best.get(True), best.get(False)
                decides = exact or loose
                out.append((exact and exact.label, decides.verdict if decides else default, loose and loose.label, tested))
            rule, verdict, loose, tested = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("key", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(loose, pa.string()), pa.array(tested, pa.int32())],
                ["key", "host", "path", "rule", "verdict", "method_rule", "tested"],
            )

    fields = f"key {kind}, host string, path string, rule string, verdict string, method_rule string, tested int"
    return rows.mapInArrow(run, fields).withColumnRenamed("key", key)

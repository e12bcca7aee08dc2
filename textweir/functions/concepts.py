"""Concept annotation of clauses, as Column functions over arrays of stems."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import values as V


def stem_word(w: str) -> str:
    """The stem of a constant word: the driver's twin of text.stem()."""
    n = len(w)
    if n <= 3:
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith("sses") and n >= 5:
        return w[:-2]
    if w[-1] == "s" and w[-2] not in "su":
        return w[:-1]
    for suffix, least in (("ing", 6), ("ed", 5)):
        if w.endswith(suffix) and n >= least:
            b = w[: -len(suffix)]
            if len(b) > 3 and b[-1] == b[-2] and b[-1] not in "aeiou":
                return b[:-1]
            return b + "e" if b[-3:-2] not in tuple("aeiou") and b[-2] in "aeiou" and b[-1] not in "aeiouy" and len(b) >= 3 else b
    return w[:-2] if w.endswith("ly") and n >= 5 else w


def stems_of(words: list[str]) -> list[str]:
    return sorted({stem_word(w) for w in words})


def lexicon() -> dict[str, list[str]]:
    """stem: its concepts, over all languages."""
    out: dict[str, list[str]] = {}
    for concepts in V.CONCEPTS.values():
        for concept, forms in concepts.items():
            for form in forms.split():
                own = out.setdefault(stem_word(form), [])
                if concept not in own:
                    own.append(concept)
    return out


def phrase_table() -> dict[str, str]:
    return {" ".join(stem_word(w) for w in p.split()): c for p, c in V.PHRASES.items()}


DUTCH_OVERRIDES = stems_of(V.CONCEPTS["nl"]["override"].split())
#: (label, first, second, window, ordered, required)
PAIRS = [
    ("instruction_override", "override", "instruction", 6, True, None),
    ("instruction_override", "override", "prior", 4, True, "totality"),
    ("prompt_disclosure", "reveal", "secret", 8, True, "self"),
    ("answer_shaping", "conceal", "audience", 10, False, None),
    ("answer_shaping", "conceal", "answering", 10, False, None),
    ("unrestricted_persona", "persona", "unrestricted", 8, False, None),
]
CHAINS = [("instruction_override", ("override", "totality", "instruction")), ("instruction_override", ("override", "totality", "prior")), ("prompt_disclosure", ("reveal", "self", "secret"))]
FOUND = "array<struct<i:int,concept:string>>"


def constant_map(table: dict) -> Column:
    kind = "array<string>" if isinstance(next(iter(table.values())), list) else "string"
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")


def found(stems: Column) -> Column:
    """array<struct<i, concept>> of a clause's stems, by place, then concept."""
    n = F.size(stems)
    at = lambda i: F.get(stems, i)
    neg = stems_of(V.NEGATORS)
    lex, phrases, turned = constant_map(lexicon()), constant_map(phrase_table()), constant_map({k: v for k, v in V.NEGATED.items() if v})
    dropped = [k for k, v in V.NEGATED.items() if v is None]

    def negated(i: Column) -> Column:
        low = F.greatest(i - 3, F.lit(0))
        left, right = F.slice(stems, low + 1, i - low), F.slice(stems, i + 2, F.lit(6))
        return F.arrays_overlap(left, T.strings(neg)) | F.arrays_overlap(right, T.strings(neg))

    def said(concepts: Column, no: Column) -> Column:
        out = F.transform(concepts, lambda c: F.when(~no, c).when(c.isin(*dropped), None).otherwise(F.coalesce(turned[c], c)))
        return F.filter(out, lambda c: c.isNotNull())

    def own(i: Column) -> Column:
        words = F.when(lex[at(i)].isNotNull(), said(lex[at(i)], negated(i))).otherwise(F.array().cast("array<string>"))
        parts = [words]
        for size in (3, 2):
            cut = F.slice(stems, i + 1, F.lit(size))
            inside = F.arrays_overlap(cut, T.strings(neg))
            concept = phrases[F.array_join(cut, " ")]
            hit = (i + size <= n) & concept.isNotNull()
            parts.append(F.when(hit, said(F.array(concept), ~inside & negated(i))).otherwise(F.array().cast("array<string>")))
        persona = at(i).isin(*stems_of(V.PRONOUNS)) & F.coalesce(at(i + 1).isin(*stems_of(V.COPULAS)), F.lit(False))
        parts.append(F.when(persona, F.array(F.lit("persona"))).otherwise(F.array().cast("array<string>")))
        prior = (i > 0) & F.coalesce(at(i - 1).isin(*stems_of(V.DETERMINERS)), F.lit(False)) & F.coalesce(F.array_contains(lex[at(i)], "prior"), F.lit(False))
        prior = prior & (at(i + 1).isNull() | at(i + 1).isin(*stems_of(V.COORDINATORS)))
        parts.append(F.when(prior, F.array(F.lit("instruction"))).otherwise(F.array().cast("array<string>")))
        return F.transform(F.concat(*parts), lambda c: F.struct(i.cast("int").alias("i"), c.alias("concept")))

    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), own))
    # most clauses hold no word of the lexicon: a hashed overlap test spares them the rest
    likely = F.arrays_overlap(stems, T.strings(sorted({*lexicon(), *stems_of(V.PRONOUNS), *[p.split()[0] for p in phrase_table()]})))
    return F.when((n > 0) & likely, F.array_sort(every)).otherwise(F.array().cast(FOUND))


def begins(stems: set[str]) -> str:
    """A regex, for lower case, that a text matches where a word has one of the stems: one begins with the root of it.

    stem() only cuts suffixes, and restores at most one final e or y, so a word begins with its stem less these.
    """
    roots: dict[str, set] = {}
    for s in stems:
        root = s[:-1] if len(s) > 1 and s[-1] in "ey" else s
        roots.setdefault(root[0], set()).add(root[1:])
    # by first letter, so that most words fail at once
    # what stands before is taken in, which costs a place less than looking back
    return "(?:^|[^0-9a-z])(?:" + "|".join(f"{a}(?:{'|'.join(re.escape(x) for x in sorted(rest))})" for a, rest in sorted(roots.items())) + ")"


def gate() -> str:
    """begins() for the stems of all concepts."""
    return begins({*lexicon(), *stems_of(V.PRONOUNS), *[p.split()[0] for p in phrase_table()]})


def telling(concepts: set[str]) -> set[str]:
    """Stems without one of which no concept of these is found, but for persona by a pronoun and its verb."""
    own = concepts | {k for k, v in V.NEGATED.items() if v in concepts} | ({"prior"} if "instruction" in concepts else set())
    return {s for s, cs in lexicon().items() if own & set(cs)} | {p.split()[0] for p, c in phrase_table().items() if c in own}


def candidate(clause: Column) -> Column:
    """Whether a clause in lower case may hold both ends of a pair or chain, or a pronoun for one: without that it has no label and is not bound."""
    first, last = {p[1] for p in PAIRS} | {c[0] for _, c in CHAINS}, {p[2] for p in PAIRS} | {c[-1] for _, c in CHAINS}
    said = f"(?:{'|'.join(sorted(stems_of(V.PRONOUNS)))})[a-z]{{0,4}}[^0-9a-z]+" + f"(?:{'|'.join(sorted(s.rstrip('ey') or s for s in stems_of(V.COPULAS)))})"
    return clause.rlike(f"{begins(telling(first))}|(?:^|[^0-9a-z]){said}") & clause.rlike(begins(telling(last) | set(stems_of(V.ANAPHORA))))


def needed(clauses: Column) -> Column:
    """Of clauses in lower case the candidates and what stands before one, whose instruction its pronoun may stand for."""
    flags = F.transform(clauses, candidate)
    kept = T.let(flags, lambda f: F.when(F.exists(f, lambda x: x), F.filter(clauses, lambda c, i: F.get(f, i) | F.coalesce(F.get(f, i + 1), F.lit(False)))))
    return F.coalesce(kept, F.array().cast("array<string>"))


def annotated(text: Column) -> Column:
    """array<struct<stems, found, bound, extra>> by clause; bound: a trailing pronoun may stand for an instruction.

    Stems are empty where no word of the clause begins as one of the lexicon does.
    """
    return annotations(T.lowered_clauses(text))


def annotations(clauses: Column) -> Column:
    """annotated() of clauses in lower case."""
    any_concept = gate()

    def one(clause: Column) -> Column:
        words = F.filter(F.split(T.spaced(clause), " "), lambda w: w != "")
        return F.struct(F.when(clause.rlike(any_concept), F.transform(words, T.stem)).otherwise(F.array().cast("array<string>")).alias("stems"))

    def with_found(c: Column) -> Column:
        stems = c["stems"]
        return F.struct(stems.alias("stems"), found(stems).alias("found"))

    def with_bound(c: Column) -> Column:
        f, n = c["found"], F.size(c["stems"])
        first = F.get(F.filter(f, lambda x: x["concept"] == "override"), F.lit(0))["i"]
        ok = (n > 0) & F.coalesce(F.get(c["stems"], n - 1).isin(*stems_of(V.ANAPHORA)), F.lit(False)) & first.isNotNull() & ~has(f, "instruction") & (n - 1 - first <= 3)
        extra = F.concat(f, F.array(F.struct((n - 1).cast("int").alias("i"), F.lit("instruction").alias("concept"))))
        return F.struct(c["stems"].alias("stems"), f.alias("found"), F.coalesce(ok, F.lit(False)).alias("bound"), extra.alias("extra"))

    return F.transform(F.transform(F.transform(clauses, one), with_found), with_bound)


def has(f: Column, concept: str) -> Column:
    return F.exists(f, lambda x: x["concept"] == concept)


def carried(annotations: Column) -> Column:
    """array<struct<stems, found>>: a pronoun takes the instruction of the clause before, as carried on."""
    start = F.struct(F.lit(False).alias("carry"), F.array().cast("array<struct<stems:array<string>,found:" + FOUND + ">>").alias("out"))
    done = F.aggregate(
        F.filter(annotations, lambda c: F.size(c["stems"]) >= 0),
        start,
        lambda acc, c: F.struct(
            ((acc["carry"] & c["bound"]) | has(c["found"], "instruction")).alias("carry"),
            F.concat(acc["out"], F.array(F.struct(c["stems"].alias("stems"), F.when(acc["carry"] & c["bound"], c["extra"]).otherwise(c["found"]).alias("found")))).alias("out"),
        ),
    )
    return done["out"]


def pair_labels(clause: Column) -> Column:
    """Labels of the concept pairs of a clause that stand within their windows."""
    f, stems = clause["found"], clause["stems"]
    n = F.size(stems)

    def hit(first: str, second: str, window: int, ordered: bool) -> Column:
        def near(a: Column) -> Column:
            final = (a["i"] == n - 1) & F.coalesce(F.get(stems, a["i"]).isin(*DUTCH_OVERRIDES), F.lit(False))
            way = (lambda b: (b["i"] > a["i"]) | final) if ordered else (lambda b: F.lit(True))
            return F.exists(f, lambda b: (b["concept"] == second) & (b["i"] != a["i"]) & (F.abs(b["i"] - a["i"]) <= window) & way(b))

        return F.exists(f, lambda a: (a["concept"] == first) & near(a))

    out = []
    for label, first, second, window, ordered, required in PAIRS:
        found_pair = hit(first, second, window, ordered)
        out.append(F.when(found_pair & has(f, required) if required else found_pair, F.lit(label)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def chain_labels(clause: Column) -> Column:
    """Labels of concept chains: last places strictly in order, within 20 tokens, without a coordinator between."""
    f, stems = clause["found"], clause["stems"]
    coordinators = T.strings(stems_of(V.COORDINATORS))

    def last_of(concept: str) -> Column:
        return F.array_max(F.transform(F.filter(f, lambda x: x["concept"] == concept), lambda x: x["i"]))

    out = []
    for label, concepts in CHAINS:
        last = [last_of(c) for c in concepts]
        order = (last[0] < last[1]) & (last[1] < last[2]) & (last[2] - last[0] <= 20)
        between = F.slice(stems, last[0] + 2, F.greatest(F.lit(0), last[2] - last[0] - 1))
        out.append(F.when(order & ~F.arrays_overlap(between, coordinators), F.lit(label)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def labels(text: Column, of) -> Column:
    """Distinct labels of a text's clauses; only those that a label may need are annotated."""
    kept = T.let(T.lowered_clauses(text), needed)
    return F.array_distinct(F.flatten(F.transform(carried(annotations(kept)), of)))

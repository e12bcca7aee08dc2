"""Rails: checks of one text that pass, rewrite or block it, as Column expressions.

A verdict is struct<status, content, categories, certain>; status is passed, modified or blocked, content
the text to go on with. certain is false where a rail could not look; that is never the same as passed.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import concepts as C
from ..functions import language as LG
from ..functions import lookalikes as L
from ..functions import splice
from ..functions import text as T
from ..functions import values as V

SIDES = ("input", "context", "output")
VERDICT = "struct<status:string,content:string,categories:array<string>,certain:boolean>"


def none() -> Column:
    return F.array().cast("array<string>")


def verdict(status: Column | str, content: Column, categories: Column | None = None, certain: bool | Column = True) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    certain = F.lit(certain) if isinstance(certain, bool) else certain
    return F.struct(status.alias("status"), content.alias("content"), (none() if categories is None else categories).alias("categories"), certain.alias("certain"))


def blocked_by(text: Column, categories: Column) -> Column:
    """Blocked where there are categories."""
    return T.let(categories, lambda c: verdict(F.when(F.size(c) > 0, "blocked").otherwise("passed"), text, c))


def rewritten(text: Column, new: Column, categories: Column) -> Column:
    """Modified where there are categories."""
    some = F.size(categories) > 0
    return verdict(F.when(some, "modified").otherwise("passed"), F.when(some, new).otherwise(text), categories)


@dataclass(frozen=True)
class Rail:
    """decide(text column, columns by name) gives a verdict; the flags are what a plan may rely on."""

    name: str
    decide: Callable[[Column, dict[str, Column]], Column]
    sides: tuple[str, ...] = ("input", "output")
    offline: bool = True
    incremental: bool = True
    language_agnostic: bool = False
    posture: bool = False
    placeholder: bool = False


#: By label: a text that the pattern matches holds one of the words of each list, in lower case. Patterns without an entry are always run.
GATES = {
    "instruction_override": [["ignore", "disregard"], ["instruction"]],
    "prompt_disclosure": [["prompt", "instruction", "message"], ["reveal", "print", "repeat", "show", "output"]],
    "role_reset": [["you"], ["mode", "persona", "dan", "jailbreak"]],
    "role_header": [["system", "systeem", "assist", "user", "gebruiker"], [":"]],
    "override_above": [["ignore", "disregard", "forget", "override"], ["instruction", "guideline", "rule", "direct", "prompt", "system", "above", "previous", "prior", "earlier", "preced", "foregoing"]],
    "role_assignment": [["you"], ["assistant", "ai", "model", "chatbot", "dan"]],
    "answer_shaping": [["mention", "reveal", "disclose", "tell", "say", "admit"], ["user", "them", "you", "answer", "respon"]],
    "exfiltration": [["reveal", "print", "repeat", "output", "send", "post"], ["prompt", "api", "token", "credential", "conversation"]],
    "hidden_directive": [["<!--"]],
    "unrestricted_persona": [["you", "act", "pretend", "simulate", "roleplay"], ["dan", "anything", "developer", "jailbroken", "unfiltered", "unrestricted", "without"]],
    "restrictions_lifted": [["safety", "content", "ethical", "moral", "mode"]],
    "dual_answer": [["respon", "answer", "reply", "output"], ["two", "both", "2", ":"]],
    "sentimental_wrapper": [["mother", "father", "grandma", "grandpa", "mom", "dad", "late"], ["used", "would"], ["read", "tell", "recite", "whisper"]],
    "fiction_licence": [["write", "compose", "imagine"], ["where"], ["how"]],
    "forged_authority": [["developer", "creator", "admin", "owner", "vendor", "provider", "maker", "you"], ["instruct", "order", "command", "authori", "you"]],
}


def found(text: Column, low: Column, label: str, p: str) -> Column:
    """Whether a pattern matches; low is the text in lower case, looked at for the pattern's words first."""
    out = F.lit(True)
    for words in GATES.get(label, []):
        some = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            some = some | F.contains(low, F.lit(w))
        out = out & some
    return out & text.rlike(p)


def matching(text: Column, patterns: dict[str, str]) -> Column:
    return T.let(F.lower(text), lambda low: F.filter(F.array(*[F.when(found(text, low, k, p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull()))


def any_match(text: Column, patterns: dict[str, str]) -> Column:
    def some(low: Column) -> Column:
        out = F.lit(False)
        for k, p in patterns.items():
            out = out | found(text, low, k, p)
        return out

    return T.let(F.lower(text), some)


def pattern(patterns: dict[str, str], name: str = "pattern", sides: tuple[str, ...] = ("input", "output")) -> Rail:
    """The first matching label blocks."""

    def decide(text: Column, _: dict) -> Column:
        first = T.let(F.lower(text), lambda low: F.coalesce(*[F.when(found(text, low, k, p), F.lit(k)) for k, p in patterns.items()]))
        return blocked_by(text, T.let(first, lambda f: F.when(f.isNotNull(), F.array(f)).otherwise(none())))

    return Rail(name, decide, sides)


def every_pattern(patterns: dict[str, str], name: str, sides: tuple[str, ...]) -> Rail:
    """All matching labels are reported."""
    return Rail(name, lambda text, _: blocked_by(text, matching(text, patterns)), sides)


def injection_patterns() -> Rail:
    return pattern(V.INJECTION_PATTERNS, "injection_patterns", ("input",))


def injected_instructions() -> Rail:
    return every_pattern(V.INJECTED_PATTERNS, "injected_instructions", ("context",))


def jailbreak() -> Rail:
    return every_pattern(V.JAILBREAK_PATTERNS, "jailbreak", ("input", "context"))


def paraphrase() -> Rail:
    return Rail("paraphrase", lambda text, _: blocked_by(text, C.labels(text, C.pair_labels)), ("input", "context"))


def alignment() -> Rail:
    return Rail("alignment", lambda text, _: blocked_by(text, C.labels(text, C.chain_labels)), ("input", "context"))


#: Letters from the rarest in English prose on; n-grams of rare letters are looked for first.
LETTERS = "zqxjkvbpygfwmucldrhsnioate"


#: A clause near a seed holds at least so many of the n-grams that are looked for, where the seed has as many.
HELD = 4


def telling(grams: list[str], least: float) -> tuple[list[str], int]:
    """N-grams of a seed and how many of these a text with `least` of them all must hold; the rarest by their letters."""
    missing = len(grams) - math.ceil(len(grams) * least - 1e-9)
    own = sorted(grams, key=lambda g: (" " in g, sum(LETTERS.find(c) if c in LETTERS else 30 for c in g), g))[: missing + HELD]
    return own, len(own) - missing


def trie(words: list[str]) -> str:
    """A regex for one of the words that branches letter by letter, so that a place in a text costs a few comparisons."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + (trie(rest) if all(rest) else "") for c, rest in heads.items()]  # a word that begins another stands for both
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def seed_containment(text: Column, seeds: list[str], least: float) -> Column:
    """The largest share of a seed's shingles that one clause contains; null where no clause reaches `least`.

    Of each seed some rare n-grams are looked for in the clauses in lower case. Only a clause that has one is normalised, only
    one that then has enough of them is met with seeds, and only those seeds are counted in it of which it has enough. What stands in a
    normal form stands in the text as it is, with other characters for its spaces.
    """
    known = [driver_shingles(s) for s in seeds]
    told = [telling(k, least) for k in known]
    table = F.from_json(F.lit(json.dumps([{"first": f, "need": n, "every": k} for k, (f, n) in zip(known, told, strict=True)])), "array<struct<first:array<string>,need:int,every:array<string>>>")
    first, few = sorted({g for f, _ in told for g in f}), min((n for _, n in told), default=1)
    full, short = [g for g in first if len(g) == 4], T.strings([g for g in first if len(g) < 4])  # a short seed is its own n-gram
    one = sorted({g for f, n in told for g in f[: len(f) - n + 1]})  # a clause without one of these lacks too many
    raw = "|".join([trie(w) for w in ([g for g in one if " " not in g],) if w] + [re.sub(r"(\\?\ )+", "[^0-9a-z]+", re.escape(g)) for g in one if " " in g])

    def clause(body: Column) -> Column:
        def share(s: Column) -> Column:
            own = F.filter(s["every"], lambda g: F.when(F.length(g) < 4, body == g).otherwise(F.contains(body, g)))
            return F.size(own) / F.size(s["every"])

        def near(has: Column) -> Column:
            met = F.filter(table, lambda s: F.size(F.array_intersect(s["first"], has)) >= s["need"])
            return F.when(F.size(has) >= few, F.array_max(F.transform(met, share)))

        has = F.filter(short, lambda g: F.contains(body, g))
        if full:
            has = F.concat(F.regexp_extract_all(body, F.lit(f"(?=({trie(full)}))"), F.lit(1)), has)
        return T.let(F.array_distinct(has), near)

    found = F.array_max(F.transform(F.filter(T.lowered_clauses(text), lambda c: c.rlike(raw)), lambda c: T.let(T.spaced(c), clause)))
    return T.let(found, lambda x: F.when(x >= least, x))


def similarity(seeds: list[str] = V.SEEDS, least: float = 0.75) -> Rail:
    """Blocks when a clause contains at least that share of a seed's shingles; seeds are constants of the plan."""

    def decide(text: Column, _: dict) -> Column:
        hit = seed_containment(text, seeds, least).isNotNull()
        return blocked_by(text, F.when(hit, F.array(F.lit("known_attack"))).otherwise(none()))

    return Rail("similarity", decide, ("input", "context"))


def driver_shingles(s: str, size: int = 4) -> list[str]:
    body = " ".join(re.findall(r"[^\W_]+", s.lower()))
    return [body] if len(body) <= size else sorted({body[i : i + size] for i in range(len(body) - size + 1)})


def driver_clauses(s: str) -> list[str]:
    parts = re.split(r"(?<=[.!?;:])\s+|\n+|\r+", s)
    return [x for x in (p.strip("\x00 \t\n\x0b\f\r") for p in parts) if x]


def budget(limits: dict[str, int | None] | None = None) -> Rail:
    """Blocks texts over their side's length; no limit for a side passes everything."""
    limits = {"input": 8000, "context": 60000} if limits is None else limits

    def decide(text: Column, ctx: dict[str, Column]) -> Column:
        side = ctx.get("side", F.lit("input"))
        over = F.lit(False)
        for k, n in limits.items():
            over = over | ((side == k) & (F.length(text) > n) if n is not None else F.lit(False))
        return blocked_by(text, F.when(over, F.array(F.lit("budget"))).otherwise(none()))

    return Rail("budget", decide, ("input", "context"), language_agnostic=True)


def canary(tokens: list[str]) -> Rail:
    """Blocks a text that holds a token, also across characters that are not letters, digits or hyphens."""

    def decide(text: Column, _: dict) -> Column:
        def held(body: Column, said: list[str]) -> Column:
            hit = F.lit(False)
            for t in said:
                hit = hit | F.contains(body, F.lit(t))
            return hit

        # only a text without a token is looked at without other characters, once for all tokens
        bare = [re.sub("[^A-Za-z0-9-]", "", t) for t in tokens]
        hit = held(text, tokens) | T.let(F.regexp_replace(text, "[^A-Za-z0-9-]+", ""), lambda flat: held(flat, bare))
        return blocked_by(text, F.when(hit, F.array(F.lit("canary"))).otherwise(none()))

    return Rail("canary", decide, ("input", "output"), language_agnostic=True)


def turn_count(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in V.TURN_PATTERNS[1:]), F.regexp_count(text, F.lit(V.TURN_PATTERNS[0])))


def many_shot(most: int = 4) -> Rail:
    """Strips chat-template tokens; blocks what then holds more than `most` turns."""

    def decide(text: Column, _: dict) -> Column:
        def judged(s: Column) -> Column:
            status = F.when(s["over"], "blocked").when(s["changed"], "modified").otherwise("passed")
            cats = F.when(s["over"], F.array(F.lit("many_shot"))).when(s["changed"], F.array(F.lit("template_tokens"))).otherwise(none())
            return verdict(status, F.when(s["changed"] & ~s["over"], s["bare"]).otherwise(text), cats)

        # each of these is made once: the engine takes verdicts apart in lambdas, where every use of an expression is a computation
        some = F.contains(text, F.lit("<|")) | F.contains(text, F.lit("<<")) | F.contains(text, F.lit("["))
        bare = F.when(some, F.regexp_replace(text, V.TEMPLATE_TOKENS, "")).otherwise(text)
        seen = T.let(bare, lambda b: F.struct(b.alias("bare"), (turn_count(b) > most).alias("over"), (b != text).alias("changed")))
        return T.let(seen, judged)

    return Rail("many_shot", decide, ("input", "context"))


def markup() -> Rail:
    """Removes active markup, shape after shape."""

    def decide(text: Column, _: dict) -> Column:
        now, cats = text, []
        for label, p in V.MARKUP_PATTERNS.items():
            cats.append(F.when(now.rlike(p), F.lit(label)))
            now = F.regexp_replace(now, p, "")
        return rewritten(text, now, F.filter(F.array(*cats), lambda x: x.isNotNull()))

    return Rail("markup", decide, ("output",), language_agnostic=True)


def personal_data() -> Rail:
    """Redacts addresses and numbers; exact exemptions depend on the text around a match, so this is one Arrow UDF."""

    def decide(text: Column, _: dict) -> Column:
        some = text.rlike(r"@|[0-9]")  # every shape has one: texts without are not sent to Python
        got = redact_personal()(F.when(some, text))
        return rewritten(text, got["content"], got["categories"])

    return Rail("personal_data", decide, ("input",), language_agnostic=True)


def redact_personal():
    shapes = {k: re.compile(p, re.A) for k, p in V.PERSONAL_PATTERNS.items()}
    host, remote, stand_in = (re.compile(p, re.A) for p in (V.HOST_COMMANDS, V.REMOTE_PATH, V.PLACEHOLDER_USERS))

    def checks(kind: str, m: re.Match, body: str, ticks: list[int], fences: list[int]) -> bool:
        if bisect(ticks, m.start() - 1) % 2 or bisect(fences, m.start() - 3) % 2:
            return False
        digits = re.sub(r"\D", "", m[0])
        if kind == "email":
            line = body[body.rfind("\n", 0, m.start()) + 1 : m.start()]
            return not (remote.match(body[m.end() : m.end() + 2]) or host.search(line) or stand_in.match(m[0].split("@")[0]))
        if kind == "card":
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in double) % 10 == 0
        if kind == "bsn":
            return len(digits) == 9 and len(set(digits)) > 1 and sum(int(c) * w for c, w in zip(digits, (9, 8, 7, 6, 5, 4, 3, 2, -1), strict=True)) % 11 == 0
        return True

    def one(body: str | None) -> tuple:
        cats: list[str] = []
        for kind, shape in shapes.items():
            out, at, source = [], 0, body or ""
            found = list(shape.finditer(source))
            # where code begins and ends, once a text: whether a match stands in code is then a search among these
            ticks = [m.start() for m in re.finditer("`", source)] if found else []
            fences = [m.start() for m in re.finditer(r"(?m)^```", source)] if found else []
            for m in found:
                if checks(kind, m, source, ticks, fences):
                    cats += [] if kind in cats else [kind]
                    out += [source[at : m.start()], m[0].replace(m[1], "[redacted]", 1) if m.re.groups and m[1] else "[redacted]"]
                    at = m.end()
            body = "".join([*out, source[at:]]) if out else body
        return body, cats

    @F.pandas_udf("content string, categories array<string>")
    def redact(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in s], columns=["content", "categories"])

    return redact


#: Our own shapes: provider prefixes, keys in blocks, tokens in headers, and assignments that keep their key.
SECRETS = {
    "private_key": (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[redacted]"),
    "github_token": (r"\bgh[pousr]_[A-Za-z0-9]{20,}", "[redacted]"),
    "aws_access_key": (r"\bA(?:KIA|SIA)[A-Z0-9]{16}\b", "[redacted]"),
    "api_key": (r"\bsk-[A-Za-z0-9_-]{16,}", "[redacted]"),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[redacted]"),
    "bearer": (r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/-]{16,}=*", "$1[redacted]"),
    "assignment": (r"""(?i)\b((?:api[_-]?key|secret|token|password|passwd)\b["']?\s*[:=]\s*["']?)[A-Za-z0-9+/_.=-]{8,}""", "$1[redacted]"),
}


#: A text that the pattern matches holds one of these, in lower case where that is said.
SECRET_WORDS = {
    "private_key": (False, ["-----BEGIN"]),
    "github_token": (False, ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]),
    "aws_access_key": (False, ["AKIA", "ASIA"]),
    "api_key": (False, ["sk-"]),
    "jwt": (False, ["eyJ"]),
    "bearer": (True, ["bearer"]),
    "assignment": (True, ["apikey", "api_key", "api-key", "secret", "token", "password", "passwd"]),
}


def secrets() -> Rail:
    def decide(text: Column, _: dict) -> Column:
        def shape(label: str, p: str, new: str) -> Callable[[Column], Column]:
            low, words = SECRET_WORDS[label]

            def some(body: Column) -> Column:
                out = F.lit(False)
                for w in words:
                    out = out | F.contains(body, F.lit(w))
                return out

            def step(s: Column) -> Column:
                held = T.let(F.lower(s["now"]), some) if low else some(s["now"])
                done = F.struct(F.regexp_replace(s["now"], p, new).alias("now"), F.concat(s["why"], F.array(F.lit(label))).alias("why"))
                return F.when(held & s["now"].rlike(p), done).otherwise(s)

            return step

        state = F.struct(text.alias("now"), none().alias("why"))
        for label, (p, new) in SECRETS.items():
            state = T.let(state, shape(label, p, new))
        return T.let(state, lambda s: rewritten(text, s["now"], s["why"]))

    return Rail("secrets", decide, ("output",), language_agnostic=True)


def language(supported: tuple[str, ...] = ("en", "nl")) -> Rail:
    """Never blocks: uncertain where the text or one of its clauses is in no supported language.

    Under twelve words nothing is said; up to 23 words it takes another language that is named.
    """

    def decide(text: Column, context: dict) -> Column:
        each = F.filter(F.transform(T.lowered_clauses(text), T.spaced), lambda c: F.length(c) >= 2 * LG.FLOOR - 1)  # shorter ones have fewer words
        parts = F.when(context.get("live", F.lit(True)), F.concat(F.array(T.normalize(text)), each))
        return verdict("passed", text, none(), ~F.coalesce(LG.any_unread(parts, list(supported)), F.lit(False)))

    return Rail("language", decide, ("input", "context"), posture=True)


def missing(name: str = "missing") -> Rail:
    """A placeholder for a rail that could not be built: passes, never certain."""
    return Rail(name, lambda text, _: verdict("passed", text, none(), False), SIDES, placeholder=True)


def hidden_spans(text: Column) -> Column:
    """array<struct<carrier, span>> of texts that a page hides from its readers."""

    def spans(k: str, p: str, groups: tuple[int, int]) -> Column:
        found = F.transform(captured(text, F.lit(p), *map(F.lit, groups)), lambda x: F.struct(F.lit(k).alias("carrier"), x["span"].alias("span")))
        return F.filter(found, lambda x: x["span"] != "")

    return F.flatten(F.array(*[spans(k, p, g) for k, p, g in carriers()]))


def carriers() -> list[tuple[str, str, tuple[int, int]]]:
    """(name, pattern, groups of which the longer is the span), in the order of V.CARRIER_ORDER."""
    every = {k: (p, (1, 1)) for k, p in V.CARRIERS.items()} | {k: (p, (1, g)) for k, (p, g) in V.JAVA_CARRIERS.items()}
    return [(k, *every[k]) for k in V.CARRIER_ORDER]


def captured(text: Column, p: Column, a: Column, b: Column) -> Column:
    """array<struct<full, span>> of a carrier's matches; span is the longer of two groups, the first of equal ones, without blanks around it."""
    bare = F.transform(F.regexp_extract_all(text, p, a), lambda x: F.regexp_replace(x, T.BLANK, ""))
    other = F.transform(F.regexp_extract_all(text, p, b), lambda x: F.regexp_replace(x, T.BLANK, ""))
    span = F.zip_with(bare, other, lambda x, y: F.when(F.length(y) > F.length(x), y).otherwise(x))
    return F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), span, lambda x, y: F.struct(x.alias("full"), y.alias("span")))


def looked(text: Column, rails: list[Rail], ctx: dict[str, Column]) -> Column:
    """What rails in order make of a text: struct<blocked, content, changed, certain>.

    blocked: categories of the rail that blocked, else null; changed: those of the last rail that rewrote, else null.
    """
    now = F.struct(F.lit(None).cast("array<string>").alias("blocked"), text.alias("content"), F.lit(None).cast("array<string>").alias("changed"), F.lit(True).alias("certain"))

    def by(r: Rail) -> Callable[[Column], Column]:
        def step(s: Column) -> Column:
            def seen(v: Column) -> Column:
                return F.struct(
                    F.when(v["status"] == "blocked", v["categories"]).alias("blocked"),
                    F.when(v["status"] == "modified", v["content"]).otherwise(s["content"]).alias("content"),
                    F.when(v["status"] == "modified", v["categories"]).otherwise(s["changed"]).alias("changed"),
                    (s["certain"] & ((v["status"] == "blocked") | v["certain"])).alias("certain"),
                )

            return F.when(s["blocked"].isNotNull(), s).otherwise(T.let(r.decide(s["content"], ctx), seen))

        return step

    for r in rails:
        now = T.let(now, by(r))
    return now


def settled(text: Column, s: Column) -> Column:
    """The verdict of a fold over views: s has blocked, content, changed, certain, as of looked()."""
    status = F.when(s["blocked"].isNotNull(), "blocked").when(s["changed"].isNotNull(), "modified").otherwise("passed")
    content = F.when(s["blocked"].isNull() & s["changed"].isNotNull(), s["content"]).otherwise(text)
    return verdict(status, content, F.coalesce(s["blocked"], s["changed"], none()), s["blocked"].isNotNull() | s["certain"])


def hidden(rails: list[Rail]) -> Rail:
    """Child rails over what a page hides from its readers, carrier after carrier; what they rewrite is put back into the page.

    A blocked span blocks the page. A rewritten one is replaced within its carrier, and the next carrier is looked for
    in the page as it then stands.
    """
    def decide(text: Column, ctx: dict[str, Column]) -> Column:
        every = F.array(*[F.struct(F.lit(k).alias("carrier"), F.lit(p).alias("regex"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, p, (a, b) in carriers()])

        def look(x: Column) -> Column:
            return T.let(looked(x["span"], rails, ctx), lambda v: F.struct(x["full"].alias("full"), x["span"].alias("span"), *[v[k].alias(k) for k in ("blocked", "content", "changed", "certain")]))

        def carrier(s: Column, c: Column) -> Column:
            tag = F.array(F.concat(F.lit("hidden:"), c["carrier"]))

            def folded(seen: Column) -> Column:
                block = F.get(F.filter(seen, lambda x: x["blocked"].isNotNull()), F.lit(0))
                some = F.filter(seen, lambda x: x["changed"].isNotNull())
                moved = F.filter(some, lambda x: x["content"] != x["span"])
                new = F.when(F.size(moved) > 0, splice.rebuilt(s["content"], moved, lambda x: x["full"], lambda x: splice.replace_first(x["full"], x["span"], x["content"]))).otherwise(s["content"])
                return F.struct(
                    F.concat(block["blocked"], tag).alias("blocked"),
                    new.alias("content"),
                    F.when(F.size(some) > 0, F.concat(F.element_at(some, -1)["changed"], tag)).otherwise(s["changed"]).alias("changed"),
                    (s["certain"] & ~F.exists(seen, lambda x: ~x["certain"])).alias("certain"),
                )

            spans = F.filter(captured(s["content"], c["regex"], c["a"], c["b"]), lambda x: x["span"] != "")
            return F.when(s["blocked"].isNotNull(), s).otherwise(T.let(F.transform(spans, look), folded))

        start = F.struct(F.lit(None).cast("array<string>").alias("blocked"), text.alias("content"), F.lit(None).cast("array<string>").alias("changed"), F.lit(True).alias("certain"))
        found = F.aggregate(every, start, carrier)
        return F.when(text.rlike(r"[<\[]"), T.let(found, lambda s: settled(text, s))).otherwise(verdict("passed", text))

    return Rail("hidden", decide, ("context",))


#: Views that read the text as it came, for in them the invisible characters are the message.
CARRIED = ("tags", "selectors")


def view(name: str, bare: Column, raw: Column) -> Column:
    """One decoding of a text: bare is without invisible characters, raw with them; null where there is none."""
    made: dict[str, Callable[[], Column]] = {
        "invisible": lambda: bare,
        "tags": lambda: T.decode_tags(raw),
        "selectors": lambda: T.decode_selectors(raw),
        "confusables": lambda: L.fold(bare),
        "confusables_all": lambda: L.fold_all(bare),
        "rot13": lambda: T.rot13(bare),
        "base64": lambda: T.decode_base64(bare),
        "nfkc": lambda: L.compatibility(bare),
    }
    return made[name]()


VIEWS = ("invisible", "tags", "selectors", "confusables", "confusables_all", "rot13", "base64", "nfkc")


def encoded_views(text: Column, scrubbed: Column | None = None) -> Column:
    """array<struct<carrier, span>> of decodings that differ from the text they are made of, in order; blank ones are left out."""

    def made(bare: Column) -> Column:
        every = F.array(*[F.struct(F.lit(k).alias("carrier"), view(k, bare, text).alias("span"), (text if k in ("invisible", *CARRIED) else bare).alias("base")) for k in VIEWS])
        other = F.filter(every, lambda x: (x["span"] != x["base"]) & x["span"].rlike(r"[^\x00\s]"))
        return F.transform(other, lambda x: F.struct(x["carrier"], x["span"]))

    return T.let(T.scrub(text), made) if scrubbed is None else made(scrubbed)


def put_back(bare: Column, name: Column, decoded: Column, new: Column) -> Column:
    """bare, the text without invisible characters, with the rewrite `new` of its view `decoded`; unchanged where there is no place for it."""
    run = F.lit(rf"(?<![A-Za-z0-9+/=])({V.BASE64_RUN})(?![A-Za-z0-9+/=])")

    def blobs(runs: Column) -> Column:
        pieces = F.split(F.regexp_replace(new, r"\n+\z", ""), "\n")
        pairs = F.arrays_zip(runs.alias("run"), pieces.alias("piece"))
        each = F.aggregate(pairs, bare, lambda t, x: splice.replace_first(t, x["run"], x["piece"]))
        return F.when(F.size(runs) == 0, bare).when((F.size(runs) > 1) & (F.size(pieces) == F.size(runs)), each).otherwise(splice.replace_first(bare, F.get(runs, F.lit(0)), new))

    return (
        F.when(name.isin(*CARRIED), bare)
        .when(name == "base64", T.let(F.regexp_extract_all(bare, run, F.lit(1)), blobs))
        .when(decoded == bare, new)
        .when(F.contains(bare, decoded), splice.replace_first(bare, decoded, new))
        .when(F.length(decoded) == F.length(bare), splice.aligned(bare, decoded, new))
        .otherwise(bare)
    )


def obfuscation(rails: list[Rail]) -> Rail:
    """Child rails over decodings of a text. A block blocks; a rewrite goes back into the text as it is written.

    A rewrite that has no place there, or after which the same view still draws an objection, blocks as
    unrewritable. Only the first rewritten view is put back, and the views after it are still looked at. Where nothing objects, invisible characters
    are taken out.
    """

    def decide(text: Column, ctx: dict[str, Column]) -> Column:
        def look(x: Column) -> Column:
            return T.let(looked(x["span"], rails, ctx), lambda v: F.struct(x["carrier"].alias("name"), x["span"].alias("decoded"), *[v[k].alias(k) for k in ("blocked", "content", "changed", "certain")]))

        def tagged(x: Column, which: str) -> Column:
            return F.concat(x[which], F.array(F.concat(F.lit("encoded:"), x["name"])))

        def decided(bare: Column, seen: Column) -> Column:
            def index(p: Callable[[Column], Column]) -> Column:
                return F.array_position(F.transform(seen, p), True)

            block_at, change_at = index(lambda x: x["blocked"].isNotNull()), index(lambda x: x["blocked"].isNull() & x["changed"].isNotNull())
            block = F.get(seen, (block_at - 1).cast("int"))

            def applied(m: Column) -> Column:
                def checked(new: Column) -> Column:
                    again = F.coalesce(*[F.when(m["name"] == k, view(k, new, new)) for k in VIEWS if k not in CARRIED], new)
                    calm = T.let(looked(again, rails, ctx), lambda v: v["blocked"].isNull() & v["changed"].isNull())
                    ok = m["name"].isin(*CARRIED) | ~((new == bare) & (m["content"] != m["decoded"])) & calm
                    return F.when(ok, new)

                return T.let(put_back(bare, m["name"], m["decoded"], m["content"]), checked)

            sure = ~F.exists(seen, lambda x: ~x["certain"])
            blocked = F.when(block_at > 0, tagged(block, "blocked"))

            def with_change(m: Column) -> Column:
                lost = F.concat(tagged(m, "changed"), F.array(F.lit("unrewritable")))

                def done(new: Column) -> Column:
                    first = F.when(new.isNull(), lost).otherwise(blocked)
                    return verdict(F.when(first.isNotNull(), "blocked").otherwise("modified"), F.when(first.isNotNull(), text).otherwise(new), F.coalesce(first, tagged(m, "changed")), first.isNotNull() | sure)

                return T.let(applied(m), done)

            plain = F.when(bare != text, verdict("modified", bare, F.array(F.lit("invisible_characters")), True)).otherwise(verdict("passed", text))
            rest = F.when(blocked.isNotNull(), verdict("blocked", text, blocked)).when(~sure, verdict("passed", text, none(), False)).otherwise(plain)
            changes = (change_at > 0) & ((block_at == 0) | (change_at < block_at))
            return F.when(changes, T.let(F.get(seen, (change_at - 1).cast("int")), with_change)).otherwise(rest)

        return T.let(T.scrub(text), lambda bare: T.let(F.transform(encoded_views(text, bare), look), lambda seen: decided(bare, seen)))

    return Rail("obfuscation", decide, ("input", "context"))


IMAGE_MARK, LINK_MARK = "[image removed]", "[link removed]"
#: (image or link, pattern, group of the label or none, group of the address), in the order in which they are read. The first
#: two are one pattern, so that nothing need be looked at before a match: a mark before the brackets tells images from links.
MARKDOWN = r"(!?)\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)"
LINK_SHAPES = [
    ("image", MARKDOWN, 2, 3),
    ("link", MARKDOWN, 2, 3),
    ("image", r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']?([^"'>\s]+)[^>]*>""", None, 1),
    ("link", r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'>\s]+)[^>]*>(.*?)</a>""", 2, 1),
    ("link", r"(?i)<((?:https?|data|file|ftp)://[^>\s]+)>", None, 1),
]


def payload(url: Column, most: int = 40) -> Column:
    """Whether an address carries more than one: a long query, or an encoded run in it."""
    query = F.regexp_extract(url, r"([?#].*)", 1)
    return (F.length(query) > most) | query.rlike(r"(?:%[0-9A-Fa-f]{2}){6,}|[A-Za-z0-9+/]{40,}={0,2}")


def allowed(url: Column, hosts: list[str], most: int = 40) -> Column:
    """Whether an address is of one of the hosts, or under one, and carries nothing; what is no http address is not."""
    h, ok = T.host(url), F.lit(False)
    for a in hosts:
        ok = ok | (h == a) | h.endswith("." + a)
    return F.coalesce(ok, F.lit(False)) & ~payload(url, most)


def exfiltration(allow: list[str], images: list[str] | None = None, most: int = 40) -> Rail:
    """Links and images to hosts that are not allowed, or that carry a payload, lose their address; their words stay.

    images: hosts of images, by default those of links; none at all for an empty list. An address in plain prose is no link.
    """

    def bare(hosts: list[str]) -> list[str]:
        return [h for h in (re.sub(r"^https?://", "", x.lower()).split("/")[0] for x in hosts) if h]

    hosts = {"link": bare(allow), "image": bare(allow if images is None else images)}

    def decide(text: Column, _: dict) -> Column:
        def shape(kind: str, p: str, label: int | None, address: int) -> Callable[[Column], Column]:
            def step(s: Column) -> Column:
                def of(k: int) -> Column:
                    return F.regexp_extract_all(s["now"], F.lit(p), F.lit(k))

                def seen(x: Column) -> Column:
                    mine = x["mark"] == ("!" if kind == "image" else "") if p == MARKDOWN else F.lit(True)
                    words = x["label"] if kind == "image" else F.regexp_replace(x["label"], T.BLANK, "")
                    mark = IMAGE_MARK if kind == "image" else LINK_MARK
                    bad = mine & ~allowed(x["url"], hosts[kind], most)
                    why = F.when(payload(x["url"], most), f"{kind}_payload").otherwise(f"foreign_{kind}")
                    return F.struct(x["full"].alias("full"), F.when(~bad, x["full"]).when(words == "", mark).otherwise(F.concat(words, F.lit(" " + mark))).alias("new"), F.when(bad, why).alias("why"))

                parts = {"full": of(0), "url": of(address), "label": of(label) if label else F.transform(of(0), lambda _: F.lit("")), "mark": of(1) if p == MARKDOWN else F.transform(of(0), lambda _: F.lit(""))}
                found = F.transform(F.arrays_zip(*[v.alias(k) for k, v in parts.items()]), seen)

                def done(f: Column) -> Column:
                    whys = F.array_distinct(F.filter(F.transform(f, lambda x: x["why"]), lambda w: w.isNotNull()))
                    new = F.when(F.size(whys) > 0, splice.rebuilt(s["now"], f, lambda x: x["full"], lambda x: x["new"])).otherwise(s["now"])
                    return F.struct(new.alias("now"), F.array_distinct(F.concat(s["why"], whys)).alias("why"))

                return F.when(s["now"].rlike(p), T.let(found, done)).otherwise(s)

            return step

        state = F.struct(text.alias("now"), none().alias("why"))
        for one in LINK_SHAPES:
            state = T.let(state, shape(*one))
        return T.let(state, lambda s: rewritten(text, s["now"], s["why"]))

    return Rail("exfiltration", decide, ("output",), language_agnostic=True)


def core(side: str) -> list[Rail]:
    """The deterministic rails of a side, in order."""
    concept = [jailbreak(), paraphrase(), alignment(), similarity(), many_shot()]
    first = injected_instructions() if side == "context" else injection_patterns()
    inner = [first, jailbreak()]
    return [first, *concept, obfuscation(inner), *([hidden(inner)] if side == "context" else []), language()]

"""License statements in texts: ordered signature rules with keyword prefilter and suppression.

A rule is a label, keywords, a regex and a priority. Rules of one form stand together and run only in
texts that hold the words every match of that form must have; of these rules, only those run of whose
keywords the text contains one. Every alternative of a regex holds a keyword, and no keyword has a space,
so any white space may stand between words. Of the detections, one that lies inside the interval of a detection of higher priority is suppressed (of equal
intervals and priorities the earlier rule stays). The rules are made from hand-written names and
statement forms, some hundreds in all. One projection of built-in functions: no shuffle, no Python.

Null text is empty text: no words, no labels, score 0. Repeated rows and null ids pass through. Extra
columns of docs are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import matches

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The phrases that are labels by themselves.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: (keywords, of which every written name holds one, name as written in texts, name in tags, address or "")
NAMES = {
    "mit": ("mit", r"(?:the )?mit(?: \(expat\))?", r"mit", r"opensource\.org/licenses/mit"),
    "x11": ("x11", r"x11", r"x11", ""),
    "apache": ("apache", r"apache(?: software)?(?: license)?,?(?: version)? ?(?:2(?:\.0)?|1\.[01])?", r"apache-[12]\.[01]", r"apache\.org/licenses/license-2\.0"),
    "bsd-2-clause": ("bsd", r"(?:simplified|2-clause|two-clause|freebsd) bsd|bsd[ -]2-clause", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    "bsd-3-clause": ("bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd|bsd[ -]3-clause", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    "bsd": ("bsd", r"bsd(?:[ -]style)?", r"bsd-4-clause|0bsd", ""),
    "gpl-2": ("gpl general", r"(?:gnu )?(?:general public license|gpl),?(?: ?\(gpl\))?,?(?: version| v\.?|-|v)? ?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    "gpl-3": ("gpl general", r"(?:gnu )?(?:general public license|gpl),?(?: ?\(gpl\))?,?(?: version| v\.?|-|v)? ?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl(?:-3\.0)?"),
    "gpl": ("gpl general", r"gnu (?:general public license|gpl)", r"gpl-1\.0", r"gnu\.org/copyleft/gpl"),
    "lgpl": ("lgpl general", r"(?:gnu )?(?:lesser|library) general public license(?:,? version)?(?: ?[23](?:\.[01])?)?|lgpl(?:v?[23](?:\.[01])?)?", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl"),
    "agpl": ("agpl affero", r"(?:gnu )?affero general public license(?:,? version)?(?: ?3(?:\.0)?)?|agpl(?:v?3(?:\.0)?)?", r"agpl-[13]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    "gfdl": ("documentation", r"(?:gnu )?free documentation license", r"gfdl-1\.[123]", r"gnu\.org/licenses/fdl"),
    "mpl": ("mozilla", r"mozilla public license,?(?: version| v\.?)? ?(?:[12]\.[01])?", r"mpl-[12]\.[01]", r"mozilla\.org/mpl"),
    "epl": ("eclipse", r"eclipse public license(?:,?(?: version| -)? ?v? ?[12]\.0)?", r"epl-[12]\.0", r"eclipse\.org/(?:legal|org)"),
    "edl": ("eclipse", r"eclipse distribution license", r"edl-1\.0", ""),
    "cddl": ("cddl distribution", r"common development and distribution license|cddl", r"cddl-1\.[01]", ""),
    "cpl": ("common", r"common public license", r"cpl-1\.0", ""),
    "ipl": ("ibm", r"ibm public license", r"ipl-1\.0", ""),
    "isc": ("isc", r"isc", r"isc", r"opensource\.org/licenses/isc"),
    "unlicense": ("unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense\.org"),
    "zlib": ("zlib", r"zlib(?:/libpng)?", r"zlib", ""),
    "libpng": ("libpng", r"libpng", r"libpng(?:-2\.0)?", ""),
    "wtfpl": ("wtfpl want", r"wtfpl|do what the f\S+ you want to public license", r"wtfpl", r"wtfpl\.net"),
    "boost": ("boost", r"boost software license(?: ?-? ?version 1\.0)?", r"bsl-1\.0", r"boost\.org/license"),
    "artistic": ("artistic", r"(?:perl )?artistic license(?: 2\.0)?", r"artistic-[12]\.0(?:-perl)?", ""),
    "python": ("python psf", r"python software foundation license|psf license", r"psf-2\.0|python-2\.0", ""),
    "ofl": ("ofl sil", r"sil open font license|ofl", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    "eupl": ("eupl european", r"european union public licen[cs]e|eupl", r"eupl-1\.[012]", ""),
    "postgresql": ("postgresql", r"postgresql", r"postgresql", ""),
    "openssl": ("openssl", r"openssl", r"openssl", ""),
    "ncsa": ("ncsa", r"university of illinois/?ncsa(?: open source)?|ncsa", r"ncsa", ""),
    "ms-pl": ("microsoft", r"microsoft public license", r"ms-pl", ""),
    "ms-rl": ("microsoft", r"microsoft reciprocal license", r"ms-rl", ""),
    "osl": ("software", r"open software license", r"osl-[123]\.[01]", ""),
    "afl": ("academic", r"academic free license", r"afl-[123]\.[01]", ""),
    "ecl": ("educational", r"educational community license", r"ecl-[12]\.0", ""),
    "beerware": ("beer", r"beer-?ware", r"beerware", ""),
    "vim": ("vim", r"vim", r"vim", ""),
    "w3c": ("w3c", r"w3c software(?: notice and)?", r"w3c", ""),
    "curl": ("curl", r"curl", r"curl", ""),
    "zpl": ("zope", r"zope public license", r"zpl-[12]\.[01]", ""),
    "unicode": ("unicode", r"unicode(?:, inc\.)?", r"unicode-(?:dfs-2016|3\.0)", ""),
    "php": ("php", r"php", r"php-3\.0[01]?", r"php\.net/license"),
    "ruby": ("ruby", r"ruby", r"ruby", ""),
    "odbl": ("odbl database", r"open (?:data ?commons )?database license|odbl", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "pddl": ("pddl dedication", r"public domain dedication and license|pddl", r"pddl-1\.0", ""),
    "cc0": ("cc0", r"cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    "proprietary": ("proprietary", r"proprietary", r"licenseref-proprietary", ""),
    "upl": ("permissive", r"universal permissive license", r"upl-1\.0", ""),
    "bsl": ("business", r"business source license", r"busl-1\.1", ""),
    "sspl": ("sspl server", r"server side public license|sspl", r"sspl-1\.0", ""),
    "elastic": ("elastic", r"elastic license(?: 2\.0)?", r"elastic-2\.0", ""),
    "mulan": ("mulan", r"mulan permissive software license", r"mulanpsl-[12]\.0", ""),
    "blueoak": ("oak", r"blue oak model license", r"blueoak-1\.0\.0", ""),
    "hippocratic": ("hippocratic", r"hippocratic license", r"hippocratic-2\.1", ""),
}
CC_PARTS = {"by": r"by|attribution", "by-sa": r"by-sa|attribution[ -]share-?alike", "by-nc": r"by-nc|attribution[ -]non-?commercial", "by-nd": r"by-nd|attribution[ -]no-?deriv\w*", "by-nc-sa": r"by-nc-sa|attribution[ -]non-?commercial[ -]share-?alike", "by-nc-nd": r"by-nc-nd|attribution[ -]non-?commercial[ -]no-?deriv\w*"}
#: form: (regex around the name, priority, words); tags and addresses say most, bare names least. A match
#: holds one word of each of the lists.
FORMS = {
    "granted": (r"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?", 90, [["licensed", "licenced"], ["under"]]),
    "released": (r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?", 85, [["released", "distributed", "available", "published", "provided"], ["under"]]),
    "terms": (r"(?:under|subject to) the terms of (?:the )?(?:{name})(?: licen[cs]e)?", 80, [["under", "subject"], ["terms"]]),
    "field": (r"licen[cs]e ?[:=] ?[\"']?(?:{name})", 75, [["license", "licence"]]),
    "named": (r"(?:{name})(?<!licen[cs]e) licen[cs]e", 60, [["license", "licence"]]),
}
RULE = "struct<label:string,kws:array<string>,regex:string,prio:int,n:int>"


def rules() -> list[dict]:
    """label, kws, words, regex, prio of every rule, in order."""
    names = dict(NAMES)
    for part, written in CC_PARTS.items():
        names[f"cc-{part}"] = ("cc creative", rf"(?:cc|creative commons)[ -](?:{written})(?![ -]?(?:nc|nd|sa|non|no-?d|share))(?:[ -][1234]\.[05])?", rf"cc-{part}-[1234]\.[05]", rf"creativecommons\.org/licenses/{part}/")
    out = []
    for label, (kws, name, tag, address) in names.items():
        out.append({"label": label, "kws": ["spdx"], "words": [["spdx"]], "regex": rf"spdx-licen[cs]e-identifier: ?(?:{tag})", "prio": 100})
        if address:
            out.append({"label": label, "kws": [address.split("/")[0].replace("\\", "")], "words": [[".org", ".net"]], "regex": address, "prio": 95})
        out += [{"label": label, "kws": kws.split(), "words": words, "regex": form.replace("{name}", name), "prio": prio} for form, prio, words in FORMS.values()]
    out.append({"label": "public-domain", "kws": ["domain"], "words": [["public"], ["domain"]], "regex": r"(?:in|into|to) the public domain", "prio": 70})
    out.append({"label": "all-rights-reserved", "kws": ["reserved"], "words": [["rights"], ["reserved"]], "regex": r"all rights reserved", "prio": 40})
    edge = "(?i)(?<![0-9a-z])(?:{})(?![0-9a-z])"
    return [r | {"regex": edge.format(r["regex"].replace("[ -]", "(?: |[+-])").replace(" ?", "\\s*").replace(" ", "\\s+")), "n": i} for i, r in enumerate(out)]


def groups() -> list[dict]:
    """words and rules of every form: the rules by the words that their texts must hold."""
    out: dict[str, dict] = {}
    for r in rules():
        out.setdefault(json.dumps(r["words"]), {"words": r["words"], "rules": []})["rules"].append({k: v for k, v in r.items() if k != "words"})
    return list(out.values())


def base_regex(phrase: str) -> str:
    return f"(?i)(?<!{WORD})" + GAP.join(phrase.split()) + f"(?!{WORD})"


def detections(text: Column) -> Column:
    """array<struct<label, prio, n, s, e>> of the rules' detections that no other suppresses."""
    table = F.from_json(F.lit(json.dumps(groups())), f"array<struct<words:array<array<string>>,rules:array<{RULE}>>>")

    def running(low: Column) -> Column:
        forms = F.filter(table, lambda g: F.forall(g["words"], lambda some: F.exists(some, lambda w: F.contains(low, w))))
        return F.flatten(F.transform(forms, lambda g: F.filter(g["rules"], lambda r: F.exists(r["kws"], lambda w: F.contains(low, w)) & F.rlike(text, r["regex"]))))

    run = F.element_at(F.transform(F.array(F.lower(text)), running), 1)  # so that the text is lowered once
    return F.flatten(
        F.transform(run, lambda r: F.transform(F.filter(matches(text, r["regex"]), lambda x: x.isNotNull()), lambda x: F.struct(r["label"].alias("label"), r["prio"].alias("prio"), r["n"].alias("n"), x["s"].alias("s"), x["e"].alias("e"))))
    )


def kept(found: Column) -> Column:
    """What is left after suppression by interval containment."""
    return F.filter(
        found,
        lambda x: ~F.exists(found, lambda y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & ((y["prio"] > x["prio"]) | (y["prio"] == x["prio"]) & (y["n"] < x["n"]))),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, detections."""
    every = base_regex("\x00").replace("\x00", "(?:" + "|".join(GAP.join(p.split()) for p in PHRASES) + ")")
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hit = F.col("text").rlike(every)

    def n_words(c: Column) -> Column:
        return F.regexp_count(c, F.lit(WORD + "+")).cast("long")

    t = t.select("doc_id", "text", n_words(F.col("text")).alias("n_words"), F.when(hit, F.split("text", every, -1)).alias("parts"), detections(F.col("text")).alias("found"))
    t = t.withColumn("found", F.when(F.size("found") > 0, kept(F.col("found"))).otherwise(F.col("found")))
    final = F.element_at(F.regexp_extract_all("text", F.lit(every), F.lit(0)), -1)
    base = F.filter(F.array(*[F.when(F.col("text").rlike(base_regex(p)), F.lit(label)) for p, label in PHRASES.items()]), lambda x: x.isNotNull())
    labels = F.when(F.col("parts").isNotNull(), base).otherwise(F.array().cast("array<string>"))
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["prio"])) / 100.0, F.when(F.col("parts").isNotNull(), F.lit(0.5)), F.lit(0.0))
    return t.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("parts").cast("long") - 1, F.lit(0)).alias("n_base"),
        n_words(F.element_at("parts", 1)).alias("first_word"),
        (F.col("n_words") - n_words(F.element_at("parts", -1)) - n_words(final)).alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(labels, F.transform("found", lambda x: x["label"])))).alias("labels"),
        score.alias("score"),
        F.col("found").alias("detections"),
    )

"""Column functions on candidate strings: trimming, exclusion reasons, confidence scores, names.

Everything is a Catalyst expression; none needs Python on executors. Lengths count grapheme clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exclusion reasons, as they are told.
REASON_TEXT = {
    "emptyString": "nothing but blanks",
    "emojiOnly": "emoji without words",
    "urlPattern": "a web address",
    "filePathPattern": "a path of a file",
    "analyticsKey": "a reversed domain name, as of an event",
    "dotSeparatedIdentifier": "words joined by dots, as of a symbol",
    "allCapsConstant": "a constant's name in capitals",
    "snakeCaseIdentifier": "words joined by underscores",
    "camelCaseIdentifier": "a name in camel case",
}
# Product names that begin in lower case.
PRODUCT_NAMES = ["iPhone", "iPad", "iPod", "iCloud", "iMessage", "iTunes", "iPhoto", "macOS", "iOS", "watchOS", "tvOS", "visionOS", "eBook", "eSIM"]
# Endings of type names that belong to views; the first matching one is cut from file names.
VIEW_ENDINGS = "View|Screen|Page|Controller"
FILE_ENDINGS = "ViewController|Controller|View|Screen|Page"
# Directory names that say nothing about their files.
GENERIC_DIRECTORIES = ["Sources", "Source", "src", "SwiftUI", "UIKit", "Views", "Screens", "Pages", "Controllers", "Features", "Modules", "App", "Main"]
# Reserved words of the generated language.
KEYWORDS = (
    "associatedtype class deinit enum extension fileprivate func import init inout internal let open operator private protocol public rethrows "
    "static struct subscript typealias var break case catch continue default defer do else fallthrough for guard if in repeat return throw throws "
    "try where while as false is nil self super true any some convenience dynamic final get indirect lazy mutating nonmutating optional override "
    "postfix precedence prefix required set unowned weak willSet didSet"
).split()
# Characters that separate words of a property name.
NAME_SEPARATORS = " \t\n-_.,;:!?()[]{}\"'→←↑↓•…"


def _emoji() -> str:
    """Ranges of the characters of emoji, by their Unicode properties: those shown as emoji, other emoji beyond
    Latin-1, and what joins and varies them (selector 16, joiner, keycap)."""
    import regex

    one = regex.compile(r"\p{Emoji_Presentation}|[\p{Emoji}--[\x00-\xFF]]|[\uFE0F\u200D\u20E3]", regex.V1)
    points = [k for k in range(0x1FB00) if one.match(chr(k))]
    first = [k for k, before in zip(points, [-2, *points], strict=False) if k != before + 1]
    last = [k for k, after in zip(points, [*points[1:], -2], strict=True) if after != k + 1]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(first, last, strict=True))


EMOJI = _emoji()

_BLANKS = r"^[\p{Zs}\t]+|[\p{Zs}\t]+$"


def trimmed(v: Column) -> Column:
    """Without spaces and tabs (Unicode spaces too, line ends not) at either end."""
    return F.regexp_replace(v, _BLANKS, "")


def graphemes(v: Column) -> Column:
    """Number of user-perceived characters."""
    return F.length(F.regexp_replace(v, r"\X", "x"))


def _letters_all_upper(t: Column) -> Column:
    """No letter is other than upper case (true without letters)."""
    return ~t.rlike(r"[\p{L}&&[^\p{Lu}]]")


def exclusion_reason(v: Column) -> Column:
    """Why a string is no user-facing text, or null. The first matching reason counts."""
    return reason_of(trimmed(v))


#: Exclusion rules in order, each a predicate of the trimmed text and of it in lower case. What holds the gate is kept.
GATE = "keepGate"
REASONS = [
    ("emptyString", lambda t, low: t == ""),
    ("emojiOnly", lambda t, low: t.rlike(rf"^[{EMOJI}\s\p{{Z}}]+$")),
    ("urlPattern", lambda t, low: low.rlike(r"^(https?://|ftps?://|www\.)")),
    ("filePathPattern", lambda t, low: t.rlike("^~?/")),
    (GATE, lambda t, low: F.instr(t, " ") > 0),
    ("analyticsKey", lambda t, low: low.rlike(r"^(com|org|net|io|co|app|dev)\.")),
    ("dotSeparatedIdentifier", lambda t, low: t.rlike(r"^[.]*[\p{Ll}\p{N}]+([.]+[\p{Ll}\p{N}]+)+[.]*$")),
    ("allCapsConstant", lambda t, low: (graphemes(t) >= 3) & (F.instr(t, "_") > 0) & _letters_all_upper(t)),
    ("snakeCaseIdentifier", lambda t, low: t.rlike(r"\p{L}_\p{L}")),
    ("camelCaseIdentifier", lambda t, low: t.rlike(r"(?s)^\p{Ll}.*\p{Lu}") & ~t.isin(PRODUCT_NAMES)),
]


@dataclass(frozen=True)
class Filter:
    """A caller's exclusion rule, compiled into the cascade before the rule named ``before`` (null: behind all).

    ``predicate``: a function of the trimmed text's column, or SQL over ``text``, in frames that have that column. ``told``
    follows "Skipped ... —" in diagnostics. ``version`` stands for the predicate where results are kept, if it is a function."""

    reason: str
    predicate: Callable[[Column], Column] | str
    told: str = ""
    before: str | None = None
    version: str = ""

    def key(self) -> tuple:
        return self.reason, self.predicate if isinstance(self.predicate, str) else self.version, self.told, self.before


def cascade(filters: Sequence[Filter] = ()) -> list[tuple[str, Callable[[Column, Column], Column]]]:
    """The rules with a caller's among them; of several before one rule, the first given comes first."""
    known = [name for name, _ in REASONS]
    out = []
    for f in filters:
        if f.before is not None and f.before not in known:
            raise ValueError(f"no rule {f.before}: {known}")
        if f.reason in known:
            raise ValueError(f"a rule {f.reason} is there already")
    own = lambda name: [(f.reason, (lambda t, low, p=f.predicate: F.expr(p) if isinstance(p, str) else p(t))) for f in filters if f.before == name]
    for name, rule in REASONS:
        out += [*own(name), (name, rule)]
    return out + own(None)


def reason_of(t: Column, filters: Sequence[Filter] = ()) -> Column:
    """As ``exclusion_reason``, of a trimmed text, with a caller's rules."""
    low, out = F.lower(t), None
    for name, rule in cascade(filters):
        told = F.lit(None).cast("string") if name == GATE else F.lit(name)
        # A predicate that is null does not hold.
        out = F.when(rule(t, low), told) if out is None else out.when(rule(t, low), told)
    return out


def reason_text(reason: Column, filters: Sequence[Filter] = ()) -> Column:
    texts = REASON_TEXT | {f.reason: f.told or f.reason for f in filters}
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.element_at(table, reason)


def _deltas(t: Column, n: Column, type_name: Column, property_name: Column) -> list[tuple[Column, Column]]:
    """(reason, delta) of every factor in order; a delta of 0.0 is absent. ``t``: trimmed, ``n``: its graphemes."""
    zero = F.lit(0.0)
    several = t.rlike(r"\S\s+\S")
    give = lambda when, d: F.when(when, F.lit(d)).otherwise(zero)
    length = F.when(n == 0, F.lit(-0.30)).when(n <= 2, F.lit(-0.12)).when(n <= 4, F.lit(-0.04)).otherwise(zero)
    length_text = F.when(n == 0, F.lit("empty string")).when(n <= 2, F.format_string("very short (%d chars)", n)).otherwise(F.format_string("short (%d chars)", n))
    long = F.when(n > 200, F.lit(-0.25)).when(n > 100, F.lit(-0.08)).otherwise(zero)
    long_text = F.when(n > 200, F.format_string("very long (>%d chars)", n)).otherwise(F.format_string("long (%d chars)", n))
    return [
        (length_text, length),
        (long_text, long),
        (F.lit("multi-word phrase"), give(several, 0.02)),
        (F.lit("title case"), give(several & ~t.rlike(r"(^|\s)[\p{L}&&[^\p{Lu}]]"), 0.01)),
        (F.lit("starts uppercase"), give(t.rlike(r"^\p{Lu}"), 0.01)),
        (F.lit("contains digits"), give(t.rlike(r"\p{N}"), -0.03)),
        (F.lit("all-caps"), give((n > 4) & t.rlike(r"\p{L}") & _letters_all_upper(t), -0.08)),
        (F.lit("unusual characters"), give(t.rlike(r"[{}\[\]<>|\\^~`@#$%*=]"), -0.05)),
        (F.format_string("inside %s (View family)", type_name), give(F.coalesce(type_name.rlike(f"({VIEW_ENDINGS})$"), F.lit(False)), 0.02)),
        (F.lit("inside body property"), give(F.coalesce(property_name == "body", F.lit(False)), 0.01)),
    ]


def confidence(v: Column, base: Column, type_name: Column, property_name: Column) -> Column:
    """Base and the factors' sum (added first, in order, in doubles), within 0 and 1."""
    total = F.lit(0.0)
    for _, d in _deltas(trimmed(v), graphemes(trimmed(v)), type_name, property_name):
        total = total + d
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + total))


def confidence_of(base: Column, factors: Column) -> Column:
    """As ``confidence``, from factors that are there already."""
    total = F.aggregate(factors, F.lit(0.0), lambda sum_, f: sum_ + f["delta"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + total))


def score_factors(v: Column, type_name: Column, property_name: Column) -> Column:
    """array<struct<reason, delta>> of the factors that apply."""
    return factors_of(trimmed(v), graphemes(trimmed(v)), type_name, property_name)


def factors_of(t: Column, n: Column, type_name: Column, property_name: Column) -> Column:
    """As ``score_factors``, from columns of the trimmed text and its length, so that neither is worked out for every factor."""
    every = F.array(*[F.struct(r.alias("reason"), d.alias("delta")) for r, d in _deltas(t, n, type_name, property_name)])
    return F.filter(every, lambda f: f["delta"] != 0.0)


def score_explanation(v: Column, base: Column, type_name: Column, property_name: Column) -> Column:
    return F.struct(base.alias("base"), score_factors(v, type_name, property_name).alias("factors"), confidence(v, base, type_name, property_name).alias("final"))


def score_summary(factors: Column) -> Column:
    """"+2% multi-word phrase, -12% very short (2 chars)"."""
    return F.array_join(F.transform(factors, lambda f: F.format_string("%+.0f%% %s", f["delta"] * 100, f["reason"])), ", ")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def namespace_of_file(path: Column) -> Column:
    """File name without its extension and without the first matching view ending, unless nothing is left."""
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(stem, rf"^(.+?)({FILE_ENDINGS})$", "$1")


def directory_namespace(path: Column, base: Column) -> Column:
    """Capitalised parent directory before ``base``, unless the parent is generic or absent."""
    parent = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    return F.when(parent.isin("", ".", *GENERIC_DIRECTORIES), base).otherwise(F.concat(F.upper(F.substr(parent, F.lit(1), F.lit(1))), F.substr(parent, F.lit(2)), base))


def property_name(v: Column, suffix: Column) -> Column:
    """lowerCamelCase of the letters of ``v``'s words, then the context's suffix; "localizedString" without words."""
    pieces = F.split(F.translate(v, NAME_SEPARATORS, "\x01" * len(NAME_SEPARATORS)), "\x01")
    words = F.filter(F.transform(pieces, lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: w != "")
    rest = F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")
    return F.when(F.size(words) == 0, F.lit("localizedString")).otherwise(F.concat(F.lower(F.try_element_at(words, F.lit(1))), rest, suffix))


def backticked(name: Column) -> Column:
    return F.when(name.isin(KEYWORDS), F.concat(F.lit("`"), name, F.lit("`"))).otherwise(name)


def escaped(v: Column) -> Column:
    """Backslashes, then quotes, each behind a backslash."""
    return F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def decorative_count(v: Column) -> Column:
    """Characters that are no letter, number or white space."""
    return graphemes(F.regexp_replace(v, r"[\p{L}\p{N}\s\p{Z}]", ""))


def _parts(name: Column) -> Column:
    return F.filter(F.split(name, r"[_\-. ]"), lambda w: w != "")


def _first(w: Column, change) -> Column:
    return F.concat(change(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))


def asset_identifier(stem: Column) -> Column:
    """lowerCamelCase of a stem's parts, only first letters changed; a leading number gets an underscore."""
    words = _parts(stem)
    base = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, _first(w, F.lower)).otherwise(_first(w, F.upper))), "")
    return F.when(base == "", F.lit("_asset")).when(base.rlike(r"^\p{N}"), F.concat(F.lit("_"), base)).otherwise(base)


def asset_type_name(name: Column) -> Column:
    base = F.array_join(F.transform(_parts(name), lambda w: _first(w, F.upper)), "")
    return F.when(base == "", F.lit("_Namespace")).otherwise(base)


def full_asset_name(stem: Column, namespace: Column) -> Column:
    return F.when(F.coalesce(namespace, F.lit("")) == "", stem).otherwise(F.concat_ws("/", namespace, stem))


def shortened(v: Column, most: int = 40) -> Column:
    """At most ``most`` characters, then an ellipsis."""
    return F.when(graphemes(v) > most, F.concat(F.regexp_extract(v, rf"(?s)^\X{{{most}}}", 0), F.lit("…"))).otherwise(v)


def static_skeleton(template: Column) -> Column:
    """A literal's text without its interpolation marks."""
    return F.replace(template, F.lit("{…}"), F.lit(""))


def normal_pattern(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"\.$", "")

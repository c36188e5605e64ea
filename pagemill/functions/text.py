"""Text scalars as native Column expressions.

White space means the Unicode set of ``SPACE``, and word boundaries are ASCII: both are spelled out in
every pattern, because the JVM's own classes differ.  Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of the white-space class, for use inside brackets.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The class of the response cache also has the zero-width space.
CACHE_SPACE = SPACE + r"\u200b"
#: Where an ASCII word begins and ends.
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Prefixes that keep their hyphen at a line break.
KEPT_PREFIXES = ["well", "self", "cross", "quasi", "pseudo", "ex", "ill", "so"]

# Words that do not end an English sentence.
FUNCTION_WORDS = [
    "of", "in", "on", "at", "to", "for", "with", "from", "by", "about", "into", "onto", "upon", "via", "per", "between", "among", "within", "without",
    "under", "over", "after", "before", "during", "since", "until", "toward", "towards", "through", "across", "against", "versus", "vs", "than", "as",
    "like", "unlike", "a", "an", "the", "this", "these", "those", "its", "their", "our", "his", "her", "each", "every", "any", "some", "such", "both",
    "either", "neither", "no", "and", "or", "but", "nor", "yet", "so", "because", "although", "though", "while", "whereas", "unless", "whether", "if",
    "when", "where", "that", "which", "who", "whom", "whose", "how", "what", "why", "is", "are", "was", "were", "be", "been", "being", "has", "have",
    "had", "do", "does", "did", "can", "could", "may", "might", "shall", "should", "will", "would", "must", "not", "very", "more", "most", "less",
    "also", "only", "even", "rather", "quite",
]

# Fixed value: abbreviations whose full stop does not end a sentence.
ABBREVIATION_END = r"(?i)" + B0 + r"(e\.g|i\.e|et al|etc|vs|cf|viz|fig|figs|eq|eqs|no|nos|vol|pp|approx|resp|ca|ibid|op\. cit|inc|ltd|co|dr|mr|mrs|ms|prof|jr|sr|st)\.$"

# Fixed value: code point ranges that are set as one CJK character.
CJK = r"[\u2e80-\u2fdf\u3000-\u30ff\u3100-\u312f\u3190-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef]"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space, trimmed."""
    return trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def normalize_cache_text(c: Column) -> Column:
    """The form under which a text is looked up in the response cache; case is significant."""
    return F.regexp_replace(F.regexp_replace(c, rf"[{CACHE_SPACE}]+", " "), r"^ | $", "")


clean_translation = collapse


def clip(c: Column, n: int) -> Column:
    """Collapsed, and cut to n characters with an ellipsis."""
    t = collapse(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("…")))


def fold_for_match(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), rf"[-{SPACE}]+", " ")


def join_fragments(a: Column, b: Column) -> Column:
    """Two pieces around a line break.

    A hyphen at the break is a typesetting one when lower case follows it and the word before is plain
    letters, longer than one, and no prefix that keeps its hyphen.
    """
    def joined(s: Column) -> Column:
        p, n, token, core = s["p"], s["n"], s["token"], s["core"]
        broken = F.regexp_like(n, F.lit(r"^[a-z]")) & F.regexp_like(core, F.lit(r"^[A-Za-z]{2,}$")) & ~F.lower(core).isin(KEPT_PREFIXES)
        return (
            F.when(p == "", n)
            .when(n == "", p)
            .when(token == "", F.concat(p, F.lit(" "), n))
            .when(broken, F.concat(F.substr(p, F.lit(1), F.length(p) - 1), n))
            .otherwise(F.concat(p, n))
        )

    # only a text that ends with a hyphen has a token, and looking for one backs off over every other word
    token = lambda p: F.when(F.endswith(p, F.lit("-")), F.regexp_extract(p, rf"([^{SPACE}]+)-$", 1)).otherwise(F.lit(""))
    ends = F.struct(F.regexp_replace(a, rf"[{SPACE}]+$", "").alias("p"), F.regexp_replace(b, rf"^[{SPACE}]+", "").alias("n"))
    with_token = lambda s: F.struct(s["p"].alias("p"), s["n"].alias("n"), token(s["p"]).alias("token"))
    with_core = lambda s: F.struct(s["p"].alias("p"), s["n"].alias("n"), s["token"].alias("token"), F.regexp_replace(s["token"], r"^[^A-Za-z0-9]+", "").alias("core"))
    return bound(bound(bound(ends, with_token), with_core), joined)


def join_lines(lines: Column) -> Column:
    """An array of lines as one paragraph, blank lines left out."""
    full = F.filter(F.transform(lines, trim), lambda s: s != "")
    return collapse(F.aggregate(full, F.lit(""), lambda out, s: F.when(out == "", s).otherwise(join_fragments(out, s))))


def strip_markers(c: Column) -> Column:
    """Without up to three citation markers, closing quotes or brackets at the end."""
    t = trim(c)
    for _ in range(3):
        t = F.regexp_replace(F.regexp_replace(t, rf"[{SPACE}]*[\[(][^\])]{{0,60}}[\])]$", ""), rf"[{SPACE}\"'”’)\]]+$", "")
    return t


def completeness(c: Column) -> Column:
    """struct<complete, reason, strong>: whether a text ends its sentence, and why."""
    like = lambda x, p: F.regexp_like(x, F.lit(p))
    says = lambda complete, reason, strong: F.struct(F.lit(complete).alias("complete"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(strong).alias("strong"))
    last_word = lambda t: F.regexp_replace(F.lower(F.regexp_extract(t, r"([A-Za-z'’]+)$", 1)), "’", "'")
    rest = lambda word: F.when(word.isin(FUNCTION_WORDS), says(False, F.concat(F.lit("ends-with-function-word:"), word), True)).otherwise(says(False, "no-terminal-punctuation", False))
    stripped = lambda t: (
        F.when(t == "", says(True, "only-markers", False))
        .when(like(t, ABBREVIATION_END), says(False, "abbreviation", True))
        .when(like(t, r"[.!?。！？]$"), says(True, "terminal-punctuation", False))
        .when(like(t, r"[:;：；]$"), says(True, "colon-or-semicolon", False))
        .when(like(t, r"[,，、]$"), says(False, "trailing-comma", True))
        .when(like(t, r"[-–—]$"), says(False, "trailing-dash", True))
        .when(like(t, r"[(\[{“\"]$"), says(False, "open-bracket", True))
        .otherwise(bound(last_word(t), rest))
    )
    whole = lambda raw: (
        F.when(raw == "", says(True, "empty", False))
        .when(like(raw, r"[.!?。！？]$") & ~like(raw, ABBREVIATION_END), says(True, "terminal-punctuation", False))
        .otherwise(bound(strip_markers(raw), stripped))
    )
    return bound(trim(c), whole)


def tail_context(c: Column, n: int) -> Column:
    """The last n characters, from a sentence start if one lies in their first 60 %."""
    t = trim(c)
    cut = F.right(t, F.lit(n))
    at = F.regexp_instr(cut, F.lit(rf"[.!?][{SPACE}]+[A-Z]")) - 1
    return F.when(F.length(t) <= n, t).when((at >= 0) & (at < n * 0.6), trim(F.substr(cut, at + 3))).otherwise(F.concat(F.lit("…"), trim(cut)))


def head_context(c: Column, n: int) -> Column:
    """The first n characters, up to a sentence end if one lies beyond their first 40 %."""
    t = trim(c)
    cut = F.substring(t, 1, n)
    back = F.reverse(cut)
    first = F.regexp_instr(back, F.lit(r" [.?!]"))  # counted from the end
    end = F.when(first > 0, F.length(cut) - first - 1).otherwise(F.lit(-1))
    return F.when(F.length(t) <= n, t).when(end > n * 0.4, trim(F.substr(cut, F.lit(1), end + 1))).otherwise(F.concat(trim(cut), F.lit("…")))


def estimate_tokens(c: Column) -> Column:
    """A quarter of a token for a character, 1.2 for a CJK one, rounded up."""
    cjk = F.when(F.octet_length(c) == F.length(c), 0).otherwise(F.length(c) - F.length(F.regexp_replace(c, f"{CJK}+", "")))
    return bound(cjk, lambda n: F.ceil((F.length(c) - n) / 4 + n * 1.2).cast("long"))


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over code units, 8 hex digits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    step = lambda h, code: (h.bitwiseXOR(code) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step)), 8, "0"))


def normalize_title(c: Column) -> Column:
    """Letters, digits and CJK only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9㐀-鿿]+", "")


def title_matches(a: Column, b: Column) -> Column:
    """Equal, or one a prefix of at least 6 characters of the other, once normalised."""
    x, y = normalize_title(a), normalize_title(b)
    prefix = (F.least(F.length(x), F.length(y)) >= 6) & (F.startswith(x, y) | F.startswith(y, x))
    return (x != "") & (y != "") & ((x == y) | prefix)


def numbered_level(c: Column) -> Column:
    """Depth of a heading's numbering: dotted components, 1 for a roman numeral, null without one."""
    dotted = F.regexp_extract(trim(c), rf"^(\d+(?:\.\d+)*)\.?[{SPACE}]", 1)
    roman = F.regexp_like(trim(c), F.lit(rf"^[IVXLC]+\.?[{SPACE}]"))
    return F.when(dotted != "", F.size(F.split(dotted, r"\."))).when(roman, 1)


def inline_spacing(c: Column) -> Column:
    """Spaces around brackets and punctuation set as in running text."""
    t = F.regexp_replace(c, rf"[{SPACE}]+", " ")
    for pattern, put in ((r" +([,.;:!?%)\]])", "$1"), (r"([(\[]) +", "$1"), (r"(?<=[A-Za-z0-9])(?=[(\[][A-Za-z])", " "), (r"(?<=[,;])(?=[A-Za-z])", " ")):
        t = F.regexp_replace(t, pattern, put)
    return trim(t)


def sanitize_title(c: Column, most: int = 40) -> Column:
    """Letters and digits joined by hyphens, cut to ``most`` characters; ``chapter`` when nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(t == "", F.lit("chapter")).otherwise(F.substring(t, 1, most))


def parse_retry_after(c: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date less ``now``; never negative."""
    number = F.expr("null").cast("double") if c is None else F.try_to_number(trim(c), F.lit("99999999")).cast("double")
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(trim(c), r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))) - F.unix_timestamp(now)
    return F.greatest(F.lit(0.0), F.coalesce(number, date.cast("double")))


def flatten_log(c: Column) -> Column:
    """A value for one log line: white space and quotes as underscores, 120 characters."""
    return F.substring(F.regexp_replace(c, rf"[{SPACE}\"'\\]+", "_"), 1, 120)

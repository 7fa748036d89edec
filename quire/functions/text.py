"""Column functions over prose: words, sentences, n-grams, syllables, lengths.

All are built-in expressions, so they stay inside the JVM. A null text gives null; an empty one empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The function words whose rates make a writer's fingerprint.
MARKERS = (
    "the a an of to in on at by for with from into over under about between through during "
    "against without within across after before and or but nor if then than when while where because "
    "since although though unless until whereas "
    "i you he she it we they me him her us them my your his its our their this that "
    "these those which who whom whose what any some all no none each every both either neither such "
    "same own other another "
    "is are was were be been being am do does did have has had will would can could should shall may might must "
    "more most less least few many much very quite rather too enough only even still yet just "
    "so also however additionally moreover furthermore therefore thus hence instead otherwise meanwhile indeed anyway besides "
    "really actually honestly probably possibly perhaps maybe certainly clearly obviously arguably roughly "
    "basically essentially mostly usually often sometimes never always again now here there not "
    "don't doesn't didn't isn't aren't wasn't weren't can't won't wouldn't couldn't shouldn't it's that's "
    "there's what's i'm i've i'd i'll you're you've we're we've they're let's"
).split()


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case ASCII words with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z'-]*)"), F.lit(1))


# Abbreviations whose period ends no sentence, and what may close a sentence after its mark.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St etc vs approx dept est vol Inc Ltd Fig No".split()
CLOSERS = "\"'\u2019\u201d)\\]"
#: Letters of a word, whatever the engine takes for one: all characters beyond ASCII count.
WORD_LETTERS = r"0-9A-Za-z_\x{80}-\x{10FFFF}"
_SPACE = r" \t\r\n\x0B\f"


def sentences(text: Column) -> Column:
    """Sentences without outer white space; blank ones are dropped.

    A sentence ends at . ! or ?, with at most one closing quote or bracket, before white space, and before every list item. The periods of
    abbreviations, of single capitals and of list numbers end none. The characters U+0001 and U+0002 are taken out.
    """
    t = F.translate(text, "\u0001\u0002", "")
    t = F.regexp_replace(t, rf"(?<![{WORD_LETTERS}])((?i:{'|'.join(ABBREVIATIONS)})|[A-Z])\.", "$1\u0001")
    t = F.regexp_replace(t, rf"(?dm)^[{_SPACE}]*([0-9]+)\.", "$1\u0001")
    t = F.regexp_replace(t, rf"(?dm)^([ \t\r\x0B\f]*)([-*+][{_SPACE}]|[0-9]+\)[{_SPACE}]|[0-9]+\u0001)", "\u0002$1$2")
    t = F.regexp_replace(t, rf"([.!?][{CLOSERS}]?)[{_SPACE}]+", "$1\u0002")
    parts = F.transform(F.split(t, "\u0002", -1), lambda s: F.translate(F.regexp_replace(s, rf"^[{_SPACE}]+|[{_SPACE}]+$", ""), "\u0001", "."))
    return F.filter(parts, lambda s: s != "")


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence that has any."""
    return F.filter(F.transform(sentences(text), lambda s: F.size(words(s))), lambda n: n > 0)


def ngrams(tokens: Column, n: int) -> Column:
    """All n consecutive tokens, joined by a space."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
    return bound(tokens, lambda t: F.when(F.size(t) >= n, grams(t)).otherwise(F.array().cast("array<string>")))


def mean_of(values: Column) -> Column:
    return bound(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


def sd_of(values: Column) -> Column:
    """Sample deviation; 0 for a single value."""
    squares = lambda v: bound(mean_of(v), lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return bound(values, lambda v: F.when(F.size(v) > 1, F.sqrt(squares(v) / (F.size(v) - 1))).when(F.size(v) == 1, F.lit(0.0)))


def moving_ttr(tokens: Column, window: int = 100) -> Column:
    """Mean share of distinct tokens over all windows; null for shorter sequences.

    A token is new in the windows that hold it and start after its last occurrence. With the places sorted by token, that
    occurrence stands just before, so one pass counts those windows.
    """

    def share(t: Column) -> Column:
        def new_in(p: Column, x: Column, k: Column) -> Column:
            before = F.get(p, k - 1)
            first = F.greatest(F.when(before["w"] == x["w"], before["i"] + 1).otherwise(0), x["i"] - (window - 1), F.lit(0))
            return F.greatest(F.least(x["i"], F.size(t) - window) - first + 1, F.lit(0))

        placed = F.array_sort(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        total = bound(placed, lambda p: F.aggregate(F.transform(p, lambda x, k: new_in(p, x, k)), F.lit(0).cast("long"), lambda a, n: a + n))
        return total / (F.size(t) - (window - 1)) / window

    return bound(tokens, lambda t: F.when(F.size(t) >= window, share(t)))


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word; a last e after other letters than l, e and y is silent; one at least."""
    letters = F.regexp_replace(word, "[^a-z]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = letters.rlike("[^ley]e$") & (groups > 1)
    return F.when(letters == "", F.lit(0)).otherwise(F.greatest(F.lit(1), groups - silent.cast("int")))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def normalized_line(line: Column) -> Column:
    """Duplicate key of a line: list marker off, spaces collapsed, lower case."""
    bare = F.regexp_replace(line, r"^[ \t]*([-*+]|[0-9]+[.)])[ \t]+", "")
    return F.lower(trimmed(F.regexp_replace(bare, r"[ \t\r\n]{2,}|[\t\r\n]", " ")))  # single spaces stay as they are


def canonical_number(raw: Column) -> Column:
    """One spelling per number: commas out, integral floats without a fraction."""
    spelled = lambda bare, value: F.when(value.isNull(), bare).when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(F.regexp_replace(bare, "0+$", ""))
    return bound(F.replace(raw, F.lit(","), F.lit("")), lambda bare: bound(bare.try_cast("double"), lambda value: spelled(bare, value)))


def html_text(markup: Column) -> Column:
    """Text of markup: scripts, styles and comments out, block ends as newlines, tags out, common entities decoded, blank lines squeezed."""
    t = F.regexp_replace(markup, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</(p|div|h1|h2|h3|h4|h5|h6|li|ul|ol|tr|table|section|article|blockquote|nav|header|footer)>|<br[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\r]+", " "), r"^ | $", "")), lambda x: x != "")
    return F.array_join(lines, "\n")


# Letters of Roman numerals and the form of those that are well formed.
ROMAN, ROMAN_FORM = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}, "^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def roman_value(numeral: Column) -> Column:
    """Value of a well-formed Roman numeral, else null."""
    one = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    values = F.transform(F.filter(F.split(numeral, ""), lambda c: c != ""), lambda c: F.element_at(one, c))
    signed = lambda v: F.transform(v, lambda x, i: F.when(x < F.get(v, i + 1), -x).otherwise(x))
    total = bound(values, lambda v: F.aggregate(signed(v), F.lit(0), lambda a, x: a + x))
    return F.when((numeral != "") & numeral.rlike(ROMAN_FORM), total)


#: Query parameters by which assistants mark the links that they give.
ASSISTANT = r"^utm_source=(?:chatgpt\.com|openai|copilot\.com|claude\.ai|perplexity(?:\.ai)?|gemini)$"


def without_parameters(url: Column, pattern: str = ASSISTANT) -> Column:
    """url without empty query parameters and those that match the pattern; fragments stay, urls without ? stay as they are."""
    base = F.substring_index(url, "?", 1)
    rest = F.substring(url, F.length(base) + 2, F.length(url))
    query = F.substring_index(rest, "#", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(pattern))
    marked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("?")), F.concat(base, marked, F.substring(rest, F.length(query) + 1, F.length(rest)))).otherwise(url)

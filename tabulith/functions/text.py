"""String normalisers and parsers, Column to Column, evaluated in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and typographic signs -> their plain form, one for one.
_MARKED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿŁłŠšŽžĆćČčĐđĘęĄąŚśŹźŻżŃńĞğİıŞşŐőŰűŘřĚěŮů–—‘’‚“”„…·×−\xa0"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyyLlSsZzCcCcDdEeAaSsZzZzNnGgIiSsOoUuRrEeUu--'''\"\"\"..x- "
assert len(_MARKED) == len(_PLAIN)
_SEVERAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "ð": "d", "→": "->", "±": "+-"}


def transliterate(text: Column) -> Column:
    """Western letters and signs to ASCII; others stay (native, no Python worker)."""
    out = F.translate(text, _MARKED, _PLAIN)
    for mark, plain in _SEVERAL.items():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def drop_mentions(text: Column) -> Column:
    """without anchor and reference tokens."""
    return F.regexp_replace(text, "xxref-[^ ]*|(?:xxtable-)?xxanchor-[^ ]*", "")


_HYPHENS = "[-_'`–’→]"


def norm_dataset_ws(name: Column) -> Column:
    """dataset name for matching, hyphens as spaces."""
    out = F.regexp_replace(drop_mentions(name), _HYPHENS, " ")
    out = F.regexp_replace(out, "20([0-9][0-9])", "$1")
    return transliterate(F.lower(squeeze(out)))


def norm_dataset(name: Column) -> Column:
    """as F1, but hyphens vanish (after years were shortened)."""
    out = F.regexp_replace(drop_mentions(name), "20([0-9][0-9])", "$1")
    return transliterate(F.lower(squeeze(F.regexp_replace(out, _HYPHENS, ""))))


def norm_cell(text: Column, spaces: bool = False) -> Column:
    """letters and digits only, and white space if ``spaces``."""
    return transliterate(F.regexp_replace(text, "[^\\p{L}\\p{N}\\s]" if spaces else "[^\\p{L}\\p{N}]", ""))


def strip_nonalnum(text: Column) -> Column:
    """from the first to the last word character; empty if there is none."""
    return F.regexp_extract(text, "(?U)^\\W*(\\w.*\\b)\\W*$", 1)


def remove_parens(text: Column) -> Column:
    """without (...) and [...]."""
    return F.regexp_replace(text, "\\([^)]*?\\)|\\[[^\\]]*?\\]", "")


def clean_name(text: Column) -> Column:
    return F.trim(remove_parens(F.trim(transliterate(text))))


def clean_cell(text: Column) -> Column:
    return strip_nonalnum(clean_name(text))


def query_cell(text: Column) -> Column:
    """the text of a cell as it is searched for, without [...] and (...)."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\[[^\\]]*\\]", ""), "\\([^)]*\\)", ""))


def fix_refs(text: Column) -> Column:
    """unresolved references get a token of their own; twice, for neighbours share a space."""
    pattern = "\\(\\?\\)|\\s[?]+(\\s|$)"
    return F.regexp_replace(F.regexp_replace(text, pattern, " xref-unkown "), pattern, " xref-unkown ")


def fix_highlight(text: Column) -> Column:
    """F8: joins a highlighted reference prefix with its identifier."""
    return F.regexp_replace(text, "<b>xxref</b>-(?!<b>)", "xxref-")


def strip_highlight(text: Column) -> Column:
    return F.regexp_replace(text, "</?b>", "")


def strip_version(paper_id: Column) -> Column:
    """an arXiv identifier without its version."""
    return F.regexp_replace(paper_id, "v[0-9]+$", "")


_ARXIV = "(?i)((?:preprint|arxiv|corr abs?)\\s*)*[:/]([12][0-9]{3}\\.[0-9]{4,5})(v[0-9]+)?"


def arxiv_id(reference: Column) -> Column:
    """F16: the arXiv identifier in a reference; null if there is none."""
    return F.nullif(F.regexp_extract(reference, _ARXIV, 2), F.lit(""))


def without_arxiv_id(reference: Column) -> Column:
    """F16: the reference without its first identifier if words like 'arXiv' lead to it."""
    has_prefix = F.trim(F.regexp_extract(reference, _ARXIV, 1)) != ""
    first = F.regexp_extract(reference, _ARXIV, 0)
    at = F.position(first, reference)
    cut = F.concat(F.substr(reference, F.lit(1), at - 1), F.lit(" "), F.substr(reference, at + F.length(first)))
    return F.when(has_prefix, cut).otherwise(reference)


def title_tokens(title: Column) -> Column:
    """the words of a title; of ASCII signs only space and !"$%&'*+,- part them."""
    return F.split(F.lower(transliterate(title)), "[^/a-z0-9\\\\:?#\\[\\]().-–]+")


def title_key(title: Column) -> Column:
    return F.trim(F.array_join(title_tokens(title), "-"))


def just_letters(text: Column) -> Column:
    """F18."""
    return F.trim(F.regexp_replace(text, "[^\\p{L}]+", " "))


def until_first_sign(text: Column) -> Column:
    """up to the first character that is no ASCII letter, digit or space."""
    return F.regexp_extract(text, "^[a-zA-Z0-9 ]*", 0)


def strip_anchor(reference: Column) -> Column:
    """a leading '[key]' or 'Author (2019)' becomes '[1] '."""
    return F.regexp_replace(F.concat(F.lit(" "), reference), "^((?:\\s+[^\\s]+){1,5}\\s*[(\\[][12][0-9]{3}[A-Za-z]{0,3}[\\])] |\\s*\\[[\\w .]{1,30}\\]\\s*)", "[1] ")


_ARTEFACTS = ("citename", "Bem", "BCAY", "BBOQ", "BBCQ", "BBOP", "BBCP", "BBA")


def strip_latex_artefacts(text: Column) -> Column:
    return F.regexp_replace(text, "|".join("\\\\" + a for a in _ARTEFACTS), "")


VENUES = ("arxiv.org", "acl", "machine learning", "corr", "neurips", "ai magazine", "nips", "emnlp")


def strip_conferences(title: Column) -> Column:
    names = "|".join(v.replace(".", "\\.") for v in VENUES)
    return F.regexp_replace(title, f"(?i)\\b({names})[\\s0-9.]*", "")


def best_title_part(title: Column, surnames: Column | None = None) -> Column:
    """the sentence of a raw title that looks most like a title.

    ``surnames`` is an array of lower-cased family names; null or absent means none.
    """
    parts = F.split(title, "\\. ")
    names = F.coalesce(surnames, F.array().cast("array<string>")) if surnames is not None else F.array().cast("array<string>")

    def score(part: Column, index: Column) -> Column:
        words = F.split(part, " ")
        return (
            (F.lit(10) - index)
            + F.size(words) * 2
            + 2 * F.size(F.filter(words, lambda w: (F.length(w) > 2) & w.rlike("\\p{Lu}") & ~w.rlike("\\p{Ll}")))
            - F.size(F.filter(words, lambda w: w.rlike("^\\P{L}*\\p{Lu}\\p{Ll}*(\\P{L}+\\p{Lu}\\p{Ll}*)*\\P{L}*$")))
            - 4 * F.size(F.filter(words, lambda w: F.array_contains(names, F.lower(w))))
            - 10 * F.size(F.filter(words, lambda w: F.lower(w).isin(*VENUES)))
            - F.when(F.lower(part).contains("in proceedings"), 100).otherwise(0)
        )

    scored = F.transform(parts, lambda p, i: F.struct(score(p, i).alias("score"), p.alias("part")))
    return F.rtrim(F.regexp_replace(F.when(F.size(parts) == 1, parts[0]).otherwise(F.array_max(scored)["part"]), "[ .]+$", ""))


_PUNCTUATION = "".join("\\" + c for c in string.punctuation) + "¡¿«»‘’“”§®£₤½¾º·´¨"


def tokenize(text: Column, keep_tags: bool = False) -> Column:
    """words with signs as words of their own; ``keep_tags`` leaves <, > and / alone."""
    signs = _PUNCTUATION.replace("\\<", "").replace("\\>", "").replace("\\/", "") if keep_tags else _PUNCTUATION
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, f"([{signs}])", " $1 "), "(?U)\\s+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def limit_context(highlighted: Column, tokens: int) -> Column:
    """up to ``tokens`` words on either side of every highlighted part (the intended behaviour)."""
    parts = F.split(highlighted, "(?=<b>)|(?<=</b>)")

    def words(p: Column) -> Column:
        return F.filter(F.split(p, "\\s+"), lambda w: w != "")

    def cut(p: Column, i: Column) -> Column:
        own = words(p)
        last = i == F.size(parts) - 1
        head = F.array_join(F.slice(own, 1, tokens), " ")
        tail = F.array_join(F.when(F.size(own) > tokens, F.slice(own, -tokens, tokens)).otherwise(own), " ")
        middle = F.when(F.size(own) <= 2 * tokens, F.array_join(own, " ")).otherwise(F.concat_ws(" ", head, F.lit("..."), tail))
        return F.when(p.startswith("<b>"), p).when(i == 0, tail).when(last, head).otherwise(middle)

    return squeeze(F.array_join(F.transform(parts, cut), " "))


def fold_tokens(text: Column, mask: bool = False, split_tags: bool = False, numbers: bool = True) -> Column:
    """masking, anchors, numbers and 'data set' folded for a classifier."""
    out = F.regexp_replace(text, "<b>.*?</b>", " xxmask ") if mask else text
    if split_tags:
        out = F.regexp_replace(out, "(</?b>)", " $1 ")
    out = F.regexp_replace(out, "(xxref|xxanchor)-[\\w\\d-]*", "$1 ")
    if numbers:
        out = F.regexp_replace(out, "(^|[ ])[0-9]+\\.[0-9]+(\\b|%)", " xxnum ")
        out = F.regexp_replace(out, "(^|[ ])[0-9]+(\\b|%)", " xxnum ")
    return F.regexp_replace(out, "\\bdata set\\b", " dataset ")


def snake_case(name: Column) -> Column:
    """PF10."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z](?:[a-z]+))", "$1_$2"), "([0-9a-z])([A-Z])", "$1_$2"))


def camel_case(name: Column) -> Column:
    """PF10: the inverse of snake_case."""
    parts = F.split(name, "_")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.initcap(p))), "")


def simple_anchor(anchor: Column) -> Column:
    """TX3: an identifier without dots."""
    return F.replace(anchor, F.lit("."), F.lit(""))


def flat_text(text: Column) -> Column:
    """TX4: element text flattened: spaces collapsed, signs around anchors dropped, repeated anchors once."""
    out = F.regexp_replace(text, "[ \\n\\xa0]+", " ")
    out = F.regexp_replace(out, "[(\\[]\\s*((?:xxref|xxanchor)-[\\w-]+)\\s*[)\\]]", "$1")
    out = F.regexp_replace(out, "\\b((?:xxref|xxanchor)-[\\w-]+)(?: \\1\\b)+", "$1")
    return F.trim(out)


def clean_abstract(text: Column) -> Column:
    """TX5."""
    return F.regexp_replace(text, "^\\s*[aA]bstract ?", "")


def clear_spaces(text: Column) -> Column:
    """TB12."""
    return F.trim(F.regexp_replace(text, "[\\n\\r]+|\\s\\s+", " "))


def clear_styles(text: Column) -> Column:
    """TB15: without style tags around white space and without closed and reopened ones."""
    tags = "(red|green|blue|bold|italic)"
    out = F.regexp_replace(text, f"<{tags}>(\\s*)</\\1>", "$2")
    return F.trim(F.regexp_replace(out, f"</{tags}>(\\s*)<\\1>", "$2"))


_REF = "<ref id='([^']*+)'>(.*?)</ref>"


def references_in(text: Column) -> Column:
    """TB20: the identifiers referred to, without dashes."""
    return F.transform(F.regexp_extract_all(text, F.lit(_REF), F.lit(1)), lambda r: F.replace(r, F.lit("-"), F.lit("")))


def references_as_text(text: Column) -> Column:
    """TB20: numbers bare, other references in brackets."""
    bare = F.regexp_replace(text, "<ref id='[^']*'>\\s*([0-9]+)\\s*</ref>", "$1")
    return F.regexp_replace(bare, "<ref id='[^']*'>\\s*(.*?)\\s*</ref>", "[$1]")


def remove_references(text: Column) -> Column:
    """TB21: without references and the empty brackets they leave."""
    return F.regexp_replace(F.regexp_replace(text, _REF, ""), "\\(\\s*\\)|\\[\\s*\\]", "")


def remove_styles(text: Column) -> Column:
    """TB22."""
    return F.regexp_replace(text, "</?(red|green|blue|bold|italic)>", "")


def cell_value(raw: Column) -> Column:
    """TB19: what a raw cell says."""
    return transliterate(remove_styles(references_as_text(raw)))


def match_key(text: Column) -> Column:
    """TB30: a string for matching tables: no 'Table 3:' prefix, spaces or signs."""
    out = F.regexp_replace(F.lower(text), "^\\s*(table|figure)\\s+[0-9]+(\\.[0-9]+)*\\s*[.:]?\\s*", "")
    return F.regexp_replace(transliterate(out), "[\\s\\p{Punct}]+", "")


def raw_to_html(raw: Column) -> Column:
    """SK9: style and reference markup as HTML."""
    out = F.regexp_replace(raw, "</(red|green|blue|bold|italic)>", "</span>")
    out = F.regexp_replace(out, "<(red|green|blue|bold|italic)>", "<span class=\"text-$1\">")
    out = F.replace(out, F.lit("</ref>"), F.lit("</a>"))
    return F.regexp_replace(out, "<ref id='([^']*+)'>", "<a title=\"$1\">")


def is_alpha_cell(text: Column) -> Column:
    """PF1: two ASCII letters in a row."""
    return text.rlike("[a-zA-Z]{2,}")


def is_text_cell(text: Column) -> Column:
    """PF2: begins with a letter or has two in a row."""
    return text.rlike("^\\s*[a-zA-Z]|[a-zA-Z]{2}")


def is_number_cell(text: Column) -> Column:
    """PF3."""
    return F.trim(text).rlike("^[-+±0-9eE.,%^_/() ]{2,}$|^\\s*[0-9]\\s*$")


def type_flags(original: Column, text: Column, query: Column) -> Column:
    """hints of what kind of cell an evidence speaks of, in fixed order."""
    hashed = "xxref-\\w{40}"
    flags = [
        F.when(original.contains(query), "exact"),
        F.when(text.contains("model"), "model"),
        F.when(text.contains("our"), "model-best"),
        F.when(text.contains("dataset") | text.contains("data set"), "dataset"),
        F.when(text.rlike(hashed), "external"),
        F.when(original.rlike(hashed), "external?"),
    ]
    return F.array_join(F.array_compact(F.array(*flags)), " ")


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """EV5: all character n-grams, shorter ones first."""
    def of(n: int) -> Column:
        last = F.length(text) - n + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
        return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def shingles(words: Column, low: int = 1, high: int = 5, glue: str = " ") -> Column:
    """EV4: word n-grams of every length."""
    def of(n: int) -> Column:
        last = F.size(words) - n + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), glue))
        return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def taxonomy_words(text: Column) -> Column:
    """EV4: words split at case changes and digits, lower-cased."""
    split = F.regexp_replace(F.regexp_replace(text, "'s\\b", ""), "(\\p{Lower})([A-Z])", "$1 $2")
    split = F.regexp_replace(F.regexp_replace(split, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def highlight(text: Column, phrase: str) -> Column:
    """EV8: <b> around every occurrence of a phrase, whatever its case."""
    import re

    return F.regexp_replace(text, f"(?i)\\b({re.escape(phrase)})\\b", "<b>$1</b>")


def short_names(names: Column) -> Column:
    """the initials of given names, each with a full stop."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.lit("."))), " ")

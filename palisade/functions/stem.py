"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) as one SQL expression over a lower-case word.

A y that starts a word or follows a vowel is a consonant; it is written Y while the steps run, so that vowels are a fixed set of letters.
"""

from __future__ import annotations

from palisade.functions.text import case, lit

# The suffixes of steps 2 to 4 with what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_V, _C = "[aeiouy]", "[^aeiouy]"
#: At least one, and at least two, sequences of vowels and consonants.
_ONE = f"^{_C}*{_V}+{_C}"
_TWO = f"{_ONE}+{_V}+{_C}"
#: Consonant, vowel, consonant that is not w, x or y.
_SHORT = f"{_C}{_V}[^aeiouywxY]$"


def _let(value: str, name: str, body: str) -> str:
    """The body with a name for the value, which is then evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _has(text: str, pattern: str) -> str:
    return f"{text} rlike {lit(pattern)}"


def _drop(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def _replaced(word: str, suffixes: dict[str, str]) -> str:
    """The longest suffix by its replacement, where a sequence stands before it."""
    found = f"regexp_extract(w, {lit('(?:' + '|'.join(suffixes) + ')$')}, 0)"
    table = "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in suffixes.items()) + ")"
    stem = "left(w, length(w) - length(s))"
    return _let(word, "w", _let(found, "s", f"if(s != '' and {_has(stem, _ONE)}, concat({stem}, {table}[s]), w)"))


def stem(word: str) -> str:
    """The stem of a word of three letters or more; a shorter one is its own."""
    start = f"regexp_replace(regexp_replace({word}, '(^|[aeiou])y', '$1Y'), 'yy', 'yY')"
    plural = _let(start, "w", case((_has("w", "(?:ss|i)es$"), _drop("w", 2)), (_has("w", "[^s]s$"), _drop("w", 1)), default="w"))
    mended = case(
        (_has("w", "(?:at|bl|iz)$"), "concat(w, 'e')"), (_has("w", "(?:([^aeiouyYlsz])\\1|[yY]{2})$"), _drop("w", 1)),
        (f"{_has('w', _ONE)} and not {_has('w', _TWO)} and {_has('w', _SHORT)}", "concat(w, 'e')"), default="w")
    past = _let(plural, "w", case(
        (_has("w", "eed$"), f"if({_has(_drop('w', 3), _ONE)}, {_drop('w', 1)}, w)"),
        (f"{_has('w', 'ed$')} and {_has(_drop('w', 2), _V)}", _let(_drop("w", 2), "w", mended)),
        (f"{_has('w', 'ing$')} and {_has(_drop('w', 3), _V)}", _let(_drop("w", 3), "w", mended)), default="w"))
    final = _let(past, "w", f"if({_has('w', '[yY]$')} and {_has(_drop('w', 1), _V)}, concat({_drop('w', 1)}, 'i'), w)")
    third = _replaced(_replaced(final, STEP_2), STEP_3)
    suffix = f"regexp_extract(w, {lit('(?:' + '|'.join(STEP_4) + '|(?<=[st])ion)$')}, 0)"
    before = "left(w, length(w) - length(s))"
    fourth = _let(third, "w", _let(suffix, "s", f"if(s != '' and {_has(before, _TWO)}, {before}, w)"))
    short = _drop("w", 1)
    fifth = _let(fourth, "w", f"if({_has('w', 'e$')} and ({_has(short, _TWO)} or {_has(short, _ONE)} and not {_has(short, _SHORT)}), {short}, w)")
    last = _let(fifth, "w", f"if({_has('w', 'll$')} and {_has(_drop('w', 1), _TWO)}, {_drop('w', 1)}, w)")
    return f"if(length({word}) < 3, {word}, lower({last}))"

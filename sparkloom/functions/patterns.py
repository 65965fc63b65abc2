"""Regular expressions and the id layout. Fixed values that results depend on."""

import re

#: White space as a Unicode-aware \s has it; Java's own \s is ASCII only.
WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PRETOKEN = rf"{CONTRACTIONS}| ?[\p{{L}}\p{{N}}_]+| ?[^{WS}\p{{L}}\p{{N}}_]+|[{WS}]+(?![^{WS}])|[{WS}]+"
#: Letters and digits apart, underscore as punctuation.
PRETOKEN_SPLIT = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"

#: Ids: 0 to 4 specials, 5 to 260 bytes, merges from 261.
SPECIALS = {"<|endoftext|>": 0, "<|pad|>": 1, "<|unk|>": 2, "<|bos|>": 3, "<|eos|>": 4}
BYTE_OFFSET, FIRST_MERGE, MAX_VOCAB = 5, 261, 32768


def longest_first(specials: dict[str, int]) -> list[str]:
    """Special strings in the order in which they are looked for, so that none hides a longer one."""
    return sorted(specials, key=lambda x: (-len(x), x))


def special_pattern(specials: dict[str, int] | None = None) -> str:
    """Alternation of the special strings, in brackets and backslashes that Java, RE2 and Python read alike."""
    return "|".join("".join(c if c.isalnum() or c == "_" else f"[{c}]" if c not in "^]\\[" else f"\\{c}" for c in x) for x in longest_first(SPECIALS if specials is None else specials))


def with_specials(split_digits: bool = False, specials: dict[str, int] | None = None) -> str:
    """The pre-token pattern for text that is first split at special strings: they are matches of their own, and what stands before one
    ends there as it would at the end of the text."""
    sp = special_pattern(specials)
    words, other = (r" ?\p{L}+| ?\p{N}+", rf"[^{WS}\p{{L}}\p{{N}}]") if split_digits else (r" ?[\p{L}\p{N}_]+", rf"[^{WS}\p{{L}}\p{{N}}_]")
    return rf"{sp}|{CONTRACTIONS}|{words}| ?(?:(?!{sp}){other})+|[{WS}]+(?:(?={sp})|(?![^{WS}]))|[{WS}]+"


def in_python(pattern: str) -> str:
    """The same pattern for Python's regex module, which spells code points in another way."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)

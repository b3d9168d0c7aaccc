"""Perturbations of texts, as column expressions with keyed random numbers.

Each takes the text, a column that identifies the row, and its parameters; a text that a perturbation does not
apply to, or leaves as it was, gives null. The random numbers of position i come from (seed, key, salt, i), so the
result is the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng, text

# Shares of the kinds of typing error, marks for punctuation noise, look-alikes of letters, and stop words.
TYPO_MIX = (("transpose", 0.011), ("delete", 0.23), ("substitute", 0.556), ("insert", 0.203))
MARKS = (",", ".", ";", ":", "!", "?")
HOMOGLYPHS = {
    "a": "â", "b": "ḃ", "c": "ĉ", "d": "ḑ", "e": "ê", "f": "ḟ", "g": "ǵ", "h": "ĥ", "i": "î", "j": "ĵ", "k": "ǩ", "l": "ᶅ", "m": "ḿ",
    "n": "ň", "o": "ô", "p": "ṕ", "q": "ʠ", "r": "ř", "s": "ŝ", "t": "ẗ", "u": "ǔ", "v": "ṽ", "w": "ẘ", "x": "ẍ", "y": "ŷ", "z": "ẑ",
    "A": "Â", "B": "Ḃ", "C": "Ĉ", "D": "Ď", "E": "Ê", "F": "Ḟ", "G": "Ǵ", "H": "Ĥ", "I": "Î", "J": "Ĵ", "K": "Ǩ", "L": "Ĺ", "M": "Ḿ",
    "N": "Ň", "O": "Ô", "P": "Ṕ", "Q": "Q", "R": "Ř", "S": "Ŝ", "T": "Ṫ", "U": "Û", "V": "Ṽ", "W": "ẘ", "X": "Ẍ", "Y": "Ŷ", "Z": "Ẑ",
}
STOP_WORDS = (
    "i", "me", "you", "he", "him", "she", "her", "it", "we", "us", "they", "them", "my", "your", "his", "its", "our", "their", "mine",
    "yours", "hers", "ours", "theirs", "this", "that", "these", "those", "who", "whom", "whose", "which", "what", "myself", "yourself",
    "himself", "herself", "itself", "ourselves", "yourselves", "themselves", "a", "an", "the", "and", "but", "or", "nor", "for", "yet",
    "so", "as", "if", "is", "are", "be", "was", "were", "being", "been",
)
# End of fixed values.
ZERO_WIDTH, SHIFT = "​", "\u000b\u000b"


def changed(new: Column, old: Column) -> Column:
    """new, or null if nothing has changed or nothing is left."""
    return text.let(lambda s: F.when(s["n"].rlike(r"\S") & (s["n"] != old), s["n"]), n=new)


def word_drop(t: Column, key: Column, p: float = 0.05, least: int = 5, seed: int = rng.SEED) -> Column:
    """Words but for a share p of them, in texts of more than least words."""
    kept = lambda s: F.filter(s["w"], lambda w, i: rng.uniform(seed, key, "drop", i) >= p)
    join = lambda s: F.when((s["n"] > least) & (F.size(s["k"]) >= least), F.array_join(s["k"], " "))
    return changed(text.let(lambda s: text.let(join, n=F.size(s["w"]), k=kept(s)), w=text.split_words(t)), t)


def replaced(items: Column, places: Column, width: int, new: Callable[[Column], Column]) -> Column:
    """items with width of them from each of places (from 0, ascending, at least width apart) replaced by the array new(place).

    What stands between two places is a slice, so only the places cost an expression each.
    """

    def parts(s: Column) -> Column:
        start = lambda k: F.coalesce(F.get(s["p"], k - 1) + width + 1, F.lit(1))
        own = F.transform(s["p"], lambda x, k: F.concat(F.slice(s["w"], start(k), x + 1 - start(k)), new(x)))
        return F.concat(F.flatten(own), F.slice(s["w"], start(F.size(s["p"])), F.size(s["w"])))

    return text.let(lambda s: F.when(F.size(s["p"]) > 0, parts(s)).otherwise(s["w"]), w=items, p=places)


def swapped(items: Column, flag: Callable[[Column, Column], Column]) -> Column:
    """items with flagged ones exchanged with the next, from left to right; neither of a pair is exchanged again.

    Flagged places are marked as next to the one before (b) or not (a); in runs of them a regular expression finds every other one.
    """

    def chosen(s: Column) -> Column:
        marks = F.transform(s["p"], lambda x, k: F.when(x == F.get(s["p"], k - 1) + 1, "b").otherwise("a"))
        kept = lambda m: F.filter(s["p"], lambda x, k: F.get(m["m"], k) != "X")
        return text.let(kept, m=F.split(F.regexp_replace(F.array_join(marks, ""), "[ab]b", "SX"), ""))

    def exchanged(s: Column) -> Column:
        flagged = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s["w"]) - 2, F.lit(0))), lambda i: (i + 1 < F.size(s["w"])) & flag(s["w"], i))
        return replaced(s["w"], text.let(chosen, p=flagged), 2, lambda x: F.array(F.get(s["w"], x + 1), F.get(s["w"], x)))

    return text.let(exchanged, w=items)


def word_swap(t: Column, key: Column, p: float = 0.05, seed: int = rng.SEED) -> Column:
    """Some adjacent words exchanged, in texts of eight words at least."""
    swap = lambda s: F.when(F.size(s["w"]) >= 8, F.array_join(swapped(s["w"], lambda w, i: rng.under(p, s["own"], i)), " "))
    return changed(text.let(swap, w=text.split_words(t), own=rng.prefix(seed, key, "swap")), t)


def char_swap(t: Column, key: Column, p: float = 0.01, seed: int = rng.SEED) -> Column:
    """Some adjacent letters or digits exchanged, in texts of thirty characters at least."""
    alnum = lambda c: c.rlike(r"^[\p{L}\p{N}]$")
    swap = lambda s: F.array_join(swapped(F.split(t, ""), lambda c, i: rng.under(p, s["own"], i) & alnum(F.get(c, i)) & alnum(F.get(c, i + 1))), "")
    return changed(F.when(F.length(t) >= 30, text.let(swap, own=rng.prefix(seed, key, "chars"))), t)


def punct_noise(t: Column, key: Column, p: float = 0.05, seed: int = rng.SEED) -> Column:
    """A mark after some letters or digits, in texts of twenty characters at least."""
    marks = F.array(*map(F.lit, MARKS))

    def noisy(s: Column) -> Column:
        hit = F.filter(F.sequence(F.lit(0), F.size(s["c"]) - 1), lambda i: rng.under(p, s["own"], i) & F.get(s["c"], i).rlike(r"^[\p{L}\p{N}]$"))
        return F.array_join(replaced(s["c"], hit, 1, lambda x: F.array(F.concat(F.get(s["c"], x), F.get(marks, rng.below(len(MARKS), seed, key, "mark", x))))), "")

    return changed(F.when(F.length(t) >= 20, text.let(noisy, c=F.split(t, ""), own=rng.prefix(seed, key, "punct"))), t)


def dict_subst(t: Column, key: Column, table: dict[str, str], p: float = 0.2, seed: int = rng.SEED) -> Column:
    """Some words of a dictionary replaced; a capital stays one."""
    words = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def one(w: Column, i: Column) -> Column:
        new = F.try_element_at(words, F.lower(w))
        cased = F.when(F.substring(w, 1, 1).rlike("^[A-Z]"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 20))).otherwise(new)
        return F.when(new.isNotNull() & (rng.uniform(seed, key, "dict", i) < p), cased).otherwise(w)

    return changed(F.array_join(F.transform(text.split_words(t), one), " "), t)


def in_places(items: Column, key: Column, share: float, salt: str, seed: int, one: Callable[[Column, Column], Column]) -> Column:
    """items, of which max(1, round(share n)) are replaced by one(item, position): those whose digests come first."""

    def last(m: Column) -> Column:
        k = F.greatest(F.lit(1), F.bround(F.size(m) * share).cast("int"))
        return F.get(F.array_sort(F.transform(m, lambda x: F.struct(x["h"], x["i"]))), k - 1)

    replaced = lambda s: F.transform(s["m"], lambda x: F.when(F.struct(x["h"], x["i"]) <= s["last"], one(x["x"], x["i"])).otherwise(x["x"]))
    marks = F.transform(items, lambda x, i: F.struct(rng.digest(seed, key, salt, i).alias("h"), i.alias("i"), x.alias("x")))  # one digest each
    return text.let(lambda s: text.let(replaced, m=s["m"], last=last(s["m"])), m=marks)


def mistyped(w: Column, mode: str, *parts: Column | str | int) -> Column:
    """A word with one typing error; words of one character are left."""

    def form(s: Column) -> Column:
        w, n = s["w"], F.length(s["w"])
        at, pair = F.floor(s["at"] * n).cast("int") + 1, F.floor(s["at"] * (n - 1)).cast("int") + 1
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), rng.below(26, *parts, "letter") + 1, F.lit(1))
        head, tail = (lambda k: F.substring(w, F.lit(1), k)), (lambda k: F.substring(w, k, n))
        forms = {
            "delete": lambda: F.concat(head(at - 1), tail(at + 1)),
            "insert": lambda: F.concat(head(at), letter, tail(at + 1)),
            "substitute": lambda: F.concat(head(at - 1), letter, tail(at + 1)),
            "transpose": lambda: F.concat(head(pair - 1), F.substring(w, pair + 1, F.lit(1)), F.substring(w, pair, F.lit(1)), tail(pair + 2)),
        }
        if mode != "mix":
            return forms[mode]()
        low, out = 0.0, F
        for name, share in TYPO_MIX:
            low += share
            out = out.when(s["mode"] < low, forms[name]())
        return out.otherwise(w)

    made = text.let(form, w=w, at=rng.uniform(*parts, "at"), mode=rng.uniform(*parts, "mode") if mode == "mix" else F.lit(0.0))
    return F.when(F.length(w) > 1, made).otherwise(w)


def typo(t: Column, key: Column, mode: str = "mix", share: float = 0.2, seed: int = rng.SEED) -> Column:
    """A typing error in a share of the words; the words are the same for every mode."""
    one = lambda w, i: mistyped(w, mode, F.lit(seed), key, i)
    return changed(F.array_join(in_places(text.split_words(t), key, share, "typo", seed, one), " "), t)


def zero_width(t: Column, key: Column, share: float = 0.2, seed: int = rng.SEED) -> Column:
    """A zero-width space inside a share of the words."""
    one = lambda w, i: F.when(F.length(w) > 1, F.concat(F.substring(w, 1, 1), F.lit(ZERO_WIDTH), F.substring(w, 2, 1 << 20))).otherwise(w)
    return changed(F.array_join(in_places(text.split_words(t), key, share, "form", seed, one), " "), t)


def shift_up(t: Column, key: Column, share: float = 0.2, seed: int = rng.SEED) -> Column:
    """Two vertical tabs after a share of the sentences."""
    return changed(F.array_join(in_places(text.sentences(t), key, share, "shift", seed, lambda x, i: F.concat(x, F.lit(SHIFT))), " "), t)


def homoglyph(t: Column, key: Column, p: float = 0.2, seed: int = rng.SEED) -> Column:
    """In some words one letter gives way to its look-alike; such a word without a letter is dropped."""
    source, target = "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values())

    def one(w: Column, i: Column) -> Column:
        letters = F.filter(F.sequence(F.lit(1), F.length(w)), lambda k: F.substring(w, k, F.lit(1)).rlike("^[A-Za-z]$"))
        at = F.get(letters, rng.below(F.size(letters), seed, key, "glyph", i))
        new = F.concat(F.substring(w, F.lit(1), at - 1), F.translate(F.substring(w, at, F.lit(1)), source, target), F.substring(w, at + 1, F.length(w)))
        return F.when(rng.uniform(seed, key, "homo", i) < p, F.when(F.size(letters) > 0, new)).otherwise(w)

    return changed(F.array_join(F.filter(F.transform(text.split_words(t), one), lambda w: w.isNotNull()), " "), t)


def mask_spans(t: Column, key: Column, share: float = 0.3, span: int = 2, buffer: int = 1, seed: int = rng.SEED) -> Column:
    """Some blocks of words, never within buffer words of each other, become numbered masks; each comes from a cell of words of its own."""
    width = span + 2 * buffer

    def picked(s: Column) -> Column:
        n, cells = F.floor(share * F.size(s["w"]) / width).cast("int"), F.floor(F.size(s["w"]) / width).cast("int")
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(cells - 1, F.lit(0))), lambda i: F.struct(rng.digest(seed, key, "span", i).alias("h"), i.alias("i"))))
        return F.array_sort(F.transform(F.slice(order, 1, n), lambda x: x["i"]))

    def masked(s: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            place = F.array_position(s["p"], F.floor(i / width).cast("int"))
            inside = (i % width >= buffer) & (i % width < buffer + span) & (place > 0)
            return F.when(~inside, w).when(i % width == buffer, F.concat(F.lit("<mask_"), (place - 1).cast("string"), F.lit(">")))

        return F.when(F.size(s["p"]) > 0, F.array_join(F.filter(F.transform(s["w"], one), lambda w: w.isNotNull()), " "))

    return changed(text.let(lambda s: text.let(masked, w=s["w"], p=picked(s)), w=text.split_words(t)), t)


def synonyms(t: Column, key: Column, table: dict[str, str], share: float = 0.2, seed: int = rng.SEED) -> Column:
    """Synonyms from a table for a share of the tokens, in texts of four at least; marks, stop words and unknown words stay."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    one = lambda w, i: F.when(~F.lower(w).isin(*STOP_WORDS), F.try_element_at(known, F.lower(w))).otherwise(w)
    joined = lambda s: F.when(F.size(s["w"]) >= 4, text.detokenize(in_places(s["w"], key, share, "syno", seed, lambda w, i: F.coalesce(one(w, i), w))))
    return changed(text.let(joined, w=text.tokenize(t)), t)


def drop_sentences(t: Column, key: Column, p: float = 0.25, seed: int = rng.SEED) -> Column:
    """Sentences but for a share p; the text itself if none would be left, null if it has none."""
    kept = lambda s: F.filter(s["s"], lambda x, i: rng.uniform(seed, key, "sentence", i) >= p)
    left = lambda s: F.when(F.size(s["k"]) > 0, F.array_join(s["k"], " ")).when(F.size(s["s"]) > 0, t)
    return text.let(lambda s: text.let(left, s=s["s"], k=kept(s)), s=text.sentences(t))


def blank_words(t: Column, key: Column, share: float = 0.015, seed: int = rng.SEED) -> Column:
    """Words at random positions, drawn with replacement, become blank; a text without words gives null."""
    draws = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.bround(n * share).cast("int"))), lambda k: rng.below(n, seed, key, "blank", k))
    blank = lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(F.array_contains(s["d"], i), "").otherwise(w)), " ")
    return text.let(lambda s: F.when(F.size(s["w"]) > 0, text.let(blank, w=s["w"], d=draws(F.size(s["w"])))), w=text.split_words(t))


def selective_drop(t: Column, key: Column, keywords: list[str], p: float = 0.2, window: int = 3, seed: int = rng.SEED) -> Column:
    """Words but for a share p of those that are no keywords; after a dropped word the next window words stay."""
    keep = F.array(*map(F.lit, keywords))

    def flags(s: Column) -> Column:
        one = F.transform(s["w"], lambda w, i: F.when(~F.array_contains(keep, F.lower(w)) & (rng.uniform(seed, key, "selective", i) < p), "1").otherwise("0"))
        return F.split(F.regexp_replace(F.array_join(one, ""), f"1([01]{{0,{window}}})", "D$1"), "")

    left = lambda s: F.array_join(F.filter(s["w"], lambda w, i: F.get(s["f"], i) != "D"), " ")
    return changed(text.let(lambda s: text.let(left, w=s["w"], f=flags(s)), w=text.split_words(t)), t)


def regenerations(temperatures: list[float], top_ps: list[float], base: tuple[float, float] = (0.8, 0.95)) -> list[dict[str, float]]:
    """Settings of a sweep over temperature and top-p without the base and without repeats (to four digits)."""
    out: list[dict[str, float]] = []
    seen = {tuple(round(x, 4) for x in base)}
    for t, p in [(t, base[1]) for t in temperatures] + [(base[0], p) for p in top_ps] + [(0.0, 1.0)]:
        if (key := (round(t, 4), round(p, 4))) not in seen:
            seen.add(key)
            out.append({"temperature": t, "top_p": p})
    return out


def pivot_language(lang: Column, t: Column) -> Column:
    """The language to translate through: German for English, English for others; a text called Russian must look it."""
    cyrillic = text.script_shares(t)["cyrillic"]
    return F.when(lang == "en", "de").when((lang == "ru") & (cyrillic < 0.2), "de").otherwise("en")


#: Perturbations by the names that configurations use.
ATTACKS: dict[str, Callable[..., Column]] = {
    "word_drop": word_drop,
    "word_swap": word_swap,
    "char_swap": char_swap,
    "punct_noise": punct_noise,
    "dict_subst": dict_subst,
    "typo": typo,
    "form_zero_sp": zero_width,
    "form_shift_u": shift_up,
    "homo": homoglyph,
    "span": mask_spans,
    "syno": synonyms,
    "sentence_deletion": drop_sentences,
    "cohesiveness_deletion": blank_words,
    "selective_deletion": selective_drop,
}


def variants(df: DataFrame, configs: list[dict], text_column: str = "text", key: str = "id") -> DataFrame:
    """(df's columns, attack, variant, attacked) for each configuration {"type": name, "variants": n, ...parameters}, in one pass over df.

    The variants of a configuration, one unless it says more, have seeds that count up from its own; unchanged texts are left out.
    """
    made = []
    for config in configs:
        own = dict(config)
        name, n, seed = own.pop("type"), own.pop("variants", 1), own.pop("seed", rng.SEED)
        for k in range(n):
            made.append(F.struct(F.lit(name).alias("attack"), F.lit(k).alias("variant"), ATTACKS[name](F.col(text_column), F.col(key).cast("string"), seed=seed + k, **own).alias("attacked")))
    return df.select("*", F.inline(F.array(*made))).where("attacked IS NOT NULL")


def attacked(df: DataFrame, configs: list[dict], text_column: str = "text", key: str = "id") -> DataFrame:
    """The same without the numbers of the variants."""
    return variants(df, configs, text_column, key).drop("variant")

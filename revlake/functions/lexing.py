"""Lexical scanning of source text with regular expressions and array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.functions.text import blank_to_null, let, newlines, pin, rest_from
from revlake.languages import FLAGS, LanguageSpec

# Window widths, in signature chunks, tried in turn for the end of a body.
# ``with_body_ends`` tells what is open then.
BODY_WINDOWS = (1, 4, 16, 64)
_WHOLE_TEXT = 2**30

OPEN, DROPPED = 0, -1

# Least number of items folded together before their results are put in one
# list: every step copies what was appended, so appended ones are kept short.
FOLD_BLOCK = 8

# Levels of braces in a body that one pattern matches as a whole. Deeper bodies,
# and those that never close, are folded brace by brace.
PATTERN_LEVELS = 6

# No array has more halvings than this.
_HALVINGS = 31


def chunk_pattern(spec: LanguageSpec) -> str:
    """Pattern whose matches cut a text before every signature.

    Joined back together the matches give the text again. Group 1 is the whole
    function for a language whose bodies are bounded by indentation.
    """
    head = spec.plain_signature
    line = r"[^\n]*+"
    if spec.decoy:
        other = f"(?:{spec.decoy}{line}|(?!{head}){line})"
    else:
        other = f"(?!{head}){line}"
    tail = rf"(?:\n{other})*+\n?"
    if spec.body == "indent":
        indented = spec.signature.replace("NAME", r"\w+").replace("INDENT", r"([ \t]*)")
        whole = rf"{indented}{line}(?:\n(?:[^\S\n]*+(?=\n|\z)|\2[ \t]{line}))*+"
        head = f"(?=({whole})){head}"
    return rf"{FLAGS}(?:{head}{line}{tail}|{other}(?:\n{other})*+\n?)"


def signature_of(spec: LanguageSpec, chunk: Column) -> Column:
    """The signature a chunk starts with, or an empty string."""
    return F.regexp_extract(chunk, rf"{FLAGS}\A(?:{spec.plain_signature})", 0)


def name_of(spec: LanguageSpec, signature: Column) -> Column:
    pattern = FLAGS + spec.named_signature
    groups = [F.regexp_extract(signature, pattern, g + 1) for g in range(spec.name_groups)]
    return F.coalesce(*[blank_to_null(g) for g in groups])


def _run_pattern(spec: LanguageSpec, stops: str) -> str:
    """Everything up to and including the next stop outside literals."""
    special = spec.literal_starts
    plain = rf"[^{stops}{special}]++"
    return rf"(?:{plain}|{"|".join(spec.literals)}|/)*+[{stops}]?"


def body_pattern(spec: LanguageSpec, levels: int = PATTERN_LEVELS) -> str:
    """What stands behind a signature up to its body's closing brace, for bodies of few levels.

    It reads the same runs as ``_run_pattern`` and gives none of them back, so a
    match ends where a fold over those runs finds the end.
    """
    run = rf"[^{{}}{spec.literal_starts}]++|{'|'.join(spec.literals)}|/"
    block = rf"\{{(?:{run})*+\}}"
    for _ in range(levels - 1):
        block = rf"\{{(?:{run}|{block})*+\}}"
    # A lexed head ends at a semicolon, and a brace that closes nothing is left to the fold.
    head = rf"(?:[^{{}};{spec.literal_starts}]++|{'|'.join(spec.literals)}|/)*+" if spec.lexed_head else r"[^{]*+"
    return rf"{FLAGS}\A{head}{block}"


def body_end(spec: LanguageSpec, text: Column) -> Column:
    """Length of ``text`` up to its body's closing brace.

    ``text`` starts after a signature. ``OPEN`` means that no closing brace was
    met and ``DROPPED`` that the signature has no body.
    """
    return let(
        F.length(F.regexp_extract(text, body_pattern(spec), 0)),
        lambda whole: F.when(whole > 0, whole).otherwise(folded_body_end(spec, text)),
    )


def folded_body_end(spec: LanguageSpec, text: Column) -> Column:
    """The same, brace by brace, for bodies of any depth."""
    # With a blank behind the text, a token ends with a stop only if it is one,
    # even when a literal that is never closed ends with a brace.
    ended = F.concat(text, F.lit(" "))
    if spec.lexed_head:
        tokens = F.regexp_extract_all(ended, F.lit(FLAGS + _run_pattern(spec, "{};")), F.lit(0))
    else:
        pattern = rf"{FLAGS}\A[^{{]*+\{{|{_run_pattern(spec, '{}')}"
        tokens = F.regexp_extract_all(ended, F.lit(pattern), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        depth, position, end = state["depth"], state["position"], state["end"]
        reached = position + F.length(token)
        closing = token.endswith("}")
        found = F.when(closing & (depth == 1), reached)
        if spec.lexed_head:
            found = found.when(token.endswith(";") & (depth == 0), F.lit(DROPPED))
        change = F.when(token.endswith("{"), 1).when(closing & (depth > 0), -1).otherwise(0)
        moved = F.struct(
            (depth + change).alias("depth"),
            reached.alias("position"),
            found.otherwise(F.lit(OPEN)).alias("end"),
        )
        return F.when(end != OPEN, state).otherwise(moved)

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("position"), F.lit(OPEN).alias("end")
    )
    return F.aggregate(tokens, start, step, lambda state: state["end"])


def blank_literals(spec: LanguageSpec, text: Column) -> Column:
    """Replace line comments by a newline, blocks by a space, strings by ``\"\"``."""
    pattern = FLAGS + spec.literal

    def replacement(literal: Column) -> Column:
        chosen = F.when(literal.startswith("//") | literal.startswith("#"), "\n")
        chosen = chosen.when(literal.startswith("/*"), " ")
        return F.when(literal.isNotNull(), chosen.otherwise('""')).otherwise("")

    return F.array_join(
        F.zip_with(
            F.split(text, pattern, -1),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda code, literal: F.concat(code, replacement(literal)),
        ),
        "",
    )


def code_only(spec: LanguageSpec, text: Column) -> Column:
    """Code with its literals taken out, in one pass.

    Runs of code are matched too, so the search never walks over them. A quote
    behind each run keeps its words apart from the next run's; line ends stay.
    """
    starts = spec.literal_starts
    literals = "|".join(spec.literals).replace(r"[^\n]*+\n?", r"[^\n]*+")
    return F.regexp_replace(text, rf"{FLAGS}([^{starts}]++)|{literals}|(/)", '$1$2"')


def match_arms(blanked: Column) -> Column:
    """Arms inside ``match`` blocks; an arm counts once per enclosing block."""
    tokens = F.regexp_extract_all(blanked, F.lit(rf"{FLAGS}\bmatch\b|[{{}};]|=>"), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        waiting, weight, stack, arms = (state[n] for n in ("waiting", "weight", "stack", "arms"))
        opens, closes = token == "{", token == "}"
        top = F.when(F.size(stack) > 0, F.element_at(stack, -1)).otherwise(F.lit(0))
        return F.struct(
            F.when(token == "match", waiting + 1)
            .when(opens | (token == ";"), F.lit(0))
            .otherwise(waiting)
            .alias("waiting"),
            F.when(opens, weight + waiting).when(closes, weight - top).otherwise(weight).alias("weight"),
            F.when(opens, F.array_append(stack, waiting))
            .when(closes & (F.size(stack) > 0), F.slice(stack, 1, F.size(stack) - 1))
            .otherwise(stack)
            .alias("stack"),
            F.when(token == "=>", arms + weight).otherwise(arms).alias("arms"),
        )

    start = F.struct(
        F.lit(0).alias("waiting"),
        F.lit(0).alias("weight"),
        F.array().cast("array<int>").alias("stack"),
        F.lit(0).alias("arms"),
    )
    counted = F.aggregate(tokens, start, step, lambda state: state["arms"])
    return F.when(blanked.contains("match"), counted).otherwise(F.lit(0))


def _joined(chunks: Column, first: Column, width: Column | int) -> Column:
    return F.array_join(F.slice(chunks, first, width), "")


def _block(items: Column) -> Column:
    """Items of a block: with the root of their number, steps inside blocks copy about as much as steps over blocks."""
    return F.greatest(F.lit(FOLD_BLOCK), F.ceil(F.sqrt(F.size(items))).cast("int"))


def scanned(items: Column, start: Column, step, emit, kind: str) -> Column:
    """What ``emit`` makes of the state behind each item, as an array of ``kind``."""

    def inner(state: Column, item: Column) -> Column:
        return let(
            step(state["now"], item),
            lambda now: F.struct(now.alias("now"), F.array_append(state["out"], emit(now)).alias("out")),
        )

    def whole(bound: Column) -> Column:
        def block(state: Column, first: Column) -> Column:
            here = F.struct(state["now"].alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
            return let(
                F.aggregate(F.slice(bound, first, _block(bound)), here, inner),
                lambda done: F.struct(done["now"].alias("now"), F.array_append(state["out"], done["out"]).alias("out")),
            )

        firsts = F.sequence(F.lit(1), F.greatest(F.size(bound), F.lit(1)), _block(bound))
        empty = F.struct(start.alias("now"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(firsts, empty, block, lambda state: F.flatten(state["out"]))

    return let(items, whole)


def _first_at_least(ordered: Column, value: Column, key=lambda x: x) -> Column:
    """Index from 0 of the first element whose key is the value or more, by halving."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        less = key(F.get(ordered, middle)) < value
        open_ = state["low"] < state["high"]
        return F.struct(
            F.when(open_ & less, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~less, middle).otherwise(state["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))
    # As many halvings as the number of elements has binary digits.
    steps = F.slice(F.array(*[F.lit(0)] * _HALVINGS), 1, F.length(F.bin(F.size(ordered))))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def _stops(spec: LanguageSpec, text: Column, begin: Column) -> Column:
    """Every opening brace of the text from ``begin`` (1-based) on, with the place of its closing one.

    Ascending structs of ``pos`` and ``end``, both numbers of characters from
    the start of ``text``; ``end`` is ``OPEN`` for a brace that never closes. In
    a language whose heads are lexed semicolons are listed too, as ``DROPPED``.

    Braces sorted by nesting level and place alternate: what follows an opening
    one on its level is its closing one. So no stack is carried.
    """
    stops = "{};" if spec.lexed_head else "{}"
    ended = F.concat(rest_from(text, begin), F.lit(" "))
    tokens = F.regexp_extract_all(ended, F.lit(FLAGS + _run_pattern(spec, stops)), F.lit(0))

    def step(now: Column, token: Column) -> Column:
        depth = now["depth"]
        opens, closes = token.endswith("{"), token.endswith("}") & (depth > 0)
        return F.struct(
            F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth).alias("depth"),
            (now["pos"] + F.length(token)).alias("pos"),
            F.when(opens, depth + 1).when(closes, depth).otherwise(0).alias("level"),
            F.when(opens, 1).when(closes, 2).when(token.endswith(";"), 3).otherwise(0).alias("kind"),
        )

    zero = F.lit(0)
    start = F.struct(zero.alias("depth"), (begin - 1).alias("pos"), zero.alias("level"), zero.alias("kind"))
    found = scanned(
        tokens, start, step, lambda now: F.struct(now["level"], now["pos"], now["kind"]),
        "struct<level:int,pos:int,kind:int>",
    )

    def pairs(braces: Column) -> Column:
        end = lambda x, y: F.when((y["level"] == x["level"]) & (y["kind"] == 2), y["pos"]).otherwise(OPEN)
        both = F.zip_with(
            braces, F.slice(braces, 2, F.size(braces)),
            lambda x, y: F.struct(x["pos"].alias("pos"), F.coalesce(end(x, y), F.lit(OPEN)).alias("end"), x["kind"].alias("kind")),
        )
        opened = F.filter(both, lambda b: b["kind"] == 1)
        return F.transform(opened, lambda b: F.struct(b["pos"].alias("pos"), b["end"].alias("end")))

    def ends(stops: Column) -> Column:
        braces = F.array_sort(F.filter(stops, lambda x: (x["kind"] == 1) | (x["kind"] == 2)))
        semicolons = F.transform(
            F.filter(stops, lambda x: x["kind"] == 3), lambda x: F.struct(x["pos"].alias("pos"), F.lit(DROPPED).alias("end"))
        )
        found = let(braces, pairs)
        return F.array_sort(F.concat(found, semicolons) if spec.lexed_head else found)

    return let(found, ends)


def _body_start(spec: LanguageSpec, chunk: Column, head: Column) -> Column:
    """Characters of a chunk up to where its signature's body starts (or is ruled out), 0 if elsewhere."""
    rest = rest_from(chunk, head + 1)
    if spec.lexed_head:
        token = F.regexp_extract(F.concat(rest, F.lit(" ")), rf"{FLAGS}\A{_run_pattern(spec, '{};')}", 0)
        return F.when(token.endswith("{") | token.endswith(";"), head + F.length(token)).otherwise(0)
    return let(F.instr(rest, "{"), lambda at: F.when(at > 0, head + at).otherwise(0))


def body_starts(spec: LanguageSpec, chunks: Column) -> Column:
    """For every chunk where it begins and where the body of its signature starts.

    Structs of ``offset``, ``is_function``, ``first`` (the place of the first
    brace, 0 if there is none) and ``end``, in characters of the text. ``end`` is
    null until ``one_pass`` tells it; it may be ``OPEN`` or ``DROPPED``.

    The text is read once from the first body on. Reading from another signature
    is the same from any brace on that both see, so one pass serves all of them.
    Signatures inside a literal of that pass are served by a second one, from
    the first of them on; what neither sees is read on its own.
    """

    def place(chunk: Column) -> Column:
        def with_signature(signature: Column) -> Column:
            head = F.length(signature) - F.when(signature.endswith("{"), 1).otherwise(0)
            return F.struct(
                F.length(chunk).alias("size"),
                (signature != "").alias("is_function"),
                F.when(signature != "", _body_start(spec, chunk, head)).otherwise(0).alias("own"),
                F.instr(chunk, "{").alias("raw"),
            )

        return let(signature_of(spec, chunk), with_signature)

    def moved(now: Column, x: Column) -> Column:
        offset = now["next"]
        absolute = lambda at: F.when(at > 0, offset + at).otherwise(0)
        return F.struct(
            (offset + x["size"]).alias("next"), offset.alias("offset"), x["is_function"].alias("is_function"),
            absolute(x["own"]).alias("own"), absolute(x["raw"]).alias("raw"),
        )

    zero, no = F.lit(0), F.lit(False)
    start = F.struct(zero.alias("next"), zero.alias("offset"), no.alias("is_function"), zero.alias("own"), zero.alias("raw"))
    placed = scanned(
        F.transform(chunks, place), start, moved, lambda now: F.struct(now["offset"], now["is_function"], now["own"], now["raw"]),
        "struct<offset:int,is_function:boolean,own:int,raw:int>",
    )

    def backwards(now: Column, x: Column) -> Column:
        # Without a brace of its own a signature takes the next one in the text.
        later = zero if spec.lexed_head else now["later"]
        return F.struct(
            F.when(x["raw"] > 0, x["raw"]).otherwise(now["later"]).alias("later"), x["offset"].alias("offset"),
            x["is_function"].alias("is_function"), F.when(x["own"] > 0, x["own"]).otherwise(later).alias("first"),
        )

    start = F.struct(zero.alias("later"), zero.alias("offset"), no.alias("is_function"), zero.alias("first"))
    signatures = F.reverse(
        scanned(
            F.reverse(placed), start, backwards, lambda now: F.struct(now["offset"], now["is_function"], now["first"]),
            "struct<offset:int,is_function:boolean,first:int>",
        )
    )

    # Where no brace follows at all, the body never starts.
    never = F.lit(None).cast("int") if spec.lexed_head else F.lit(OPEN)
    return F.transform(
        signatures,
        lambda x: F.struct(
            x["offset"], x["is_function"], x["first"], F.when(x["first"] == 0, never).alias("end")
        ),
    )


def one_pass(spec: LanguageSpec, text: Column, known: Column) -> Column:
    """The ends of bodies that are not known yet, as far as reading from the first of them on tells them."""
    open_ = F.filter(known, lambda x: x["is_function"] & (x["first"] > 0) & x["end"].isNull())

    def looked_up(stops: Column, at: Column) -> Column:
        found = let(_first_at_least(stops, at, lambda x: x["pos"]), lambda i: F.get(stops, i))
        return let(found, lambda x: F.when(x["pos"] == at, x["end"]))

    def told(stops: Column) -> Column:
        return F.transform(
            known,
            lambda x: F.struct(
                x["offset"], x["is_function"], x["first"], F.coalesce(x["end"], looked_up(stops, x["first"])).alias("end")
            ),
        )

    return let(
        F.get(F.transform(open_, lambda x: x["first"]), 0),
        lambda first: F.when(first.isNull(), known).otherwise(let(_stops(spec, text, first), told)),
    )


def brace_function(
    spec: LanguageSpec, chunks: Column, index: Column, signature: Column, compat: bool, ends: Column | None
) -> Column:
    """The function whose signature starts chunk ``index`` (0-based).

    A struct of its ``source`` and its length as ``size``. Of a body whose end
    the passes told, or that goes beyond the windows, only the size is told,
    which is -1 up to the end of the text. ``ends`` are those of a text of many
    chunks, or null.
    """
    first, count = index + 1, F.size(chunks)
    # A signature form that already holds the body's brace gives it back.
    head = F.length(signature) - F.when(signature.endswith("{"), 1).otherwise(0)

    def closed(text: Column) -> Column:
        def source(end: Column) -> Column:
            return F.when(end > 0, F.substring(text, F.lit(1), head + end)).when(
                end == DROPPED, F.lit("")
            )

        return let(body_end(spec, rest_from(text, head + 1)), source)

    def end_of(ends: Column) -> Column:
        return F.get(ends, index)["end"]

    def widen(found: Column, window: Column) -> Column:
        # A window that already reached the end makes the wider ones moot, and
        # an end that the passes told makes all of them moot.
        attempt = let(_joined(chunks, first, window["width"]), closed)
        here = index + window["seen"] < count
        if ends is not None:
            here = here & (ends.isNull() | (end_of(ends).isNull() & (window["width"] < BODY_WINDOWS[-1])))
        return F.when(found.isNotNull(), found).when(here, attempt)

    def of(source: Column) -> Column:
        return F.struct(source.alias("source"), F.length(source).alias("size"))

    def of_size(size: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("source"), size.alias("size"))

    widths = BODY_WINDOWS if ends is not None else (*BODY_WINDOWS, _WHOLE_TEXT)
    windows = F.array(
        *[
            F.struct(F.lit(seen).alias("seen"), F.lit(width).alias("width"))
            for seen, width in zip((0, *widths), widths)
        ]
    )
    unclosed = of_size(F.lit(-1 if spec.keep_unclosed else 0))

    def far(found: Column) -> Column:
        if ends is None:
            return F.when(found.isNull(), unclosed).otherwise(of(found))
        end = end_of(ends)
        alone = let(let(_joined(chunks, first, count), closed), lambda text: F.when(text.isNull(), unclosed).otherwise(of(text)))
        return (
            F.when(found.isNotNull(), of(found))
            .when(ends.isNull() | (end == OPEN), unclosed)
            .when(end == DROPPED, of_size(F.lit(0)))
            .when(end.isNotNull(), of_size(end - F.get(ends, index)["offset"]))
            .otherwise(alone)
        )

    block = let(F.aggregate(windows, F.lit(None).cast("string"), widen), far)
    if spec.nested:
        return block

    # Expression bodies: no brace where a body must start, so the function ends
    # at the nearer of line end and semicolon.
    own = F.get(chunks, index)
    if compat:
        has_block = F.instr(rest_from(_joined(chunks, first, count), head + 1), "{") > 0
        # The nearest line end of an expression body lies in its own chunk.
    else:
        has_block = F.regexp_extract(
            rest_from(own, head + 1), FLAGS + r"\A\s*(?::[^;{}]*+)?\{", 0
        ) != ""
    stop = F.length(F.regexp_extract(rest_from(own, head + 1), r"\A[^;\n]*+", 0))
    return F.when(has_block, block).otherwise(of(F.substring(own, F.lit(1), head + stop)))


def signature_chunks(spec: LanguageSpec, text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(spec)), F.lit(0))


def body_end_columns(choose, text: str = "added_text") -> tuple[Column, Column, Column]:
    """The expressions that ``with_body_ends`` adds one after the other.

    ``choose`` picks a value by language from one for each of the languages with
    braces. The whole would be too deeply nested an expression for the analyzer.
    """
    many = F.size("_chunks") > BODY_WINDOWS[-1]
    chunks = choose(lambda spec: signature_chunks(spec, F.col(text)))
    starts = choose(lambda spec: F.when(many, body_starts(spec, F.col("_chunks"))))
    told = choose(lambda spec: F.when(F.col("_ends").isNotNull(), one_pass(spec, F.col(text), F.col("_ends"))))
    return chunks, starts, told


def with_body_ends(df: DataFrame, columns: tuple[Column, Column, Column]) -> DataFrame:
    """Texts with their ``_chunks``, and in ``_ends`` what two passes over a text of many chunks tell of its bodies."""
    chunks, starts, told = columns
    out = pin(pin(df, _chunks=chunks), _ends=starts)
    for _ in range(2):
        out = pin(out, _told=told).drop("_ends").withColumnRenamed("_told", "_ends")
    return out


def functions_in(
    spec: LanguageSpec,
    text: Column,
    compat: bool = False,
    nested: bool | None = None,
    chunks: Column | None = None,
    ends: Column | None = None,
) -> Column:
    """Functions of a text, in order, as structs.

    ``first_line`` is the number of line ends before the signature and ``lines``
    the number of line ends in the unstripped source. ``chunks`` and ``ends`` are
    the columns of ``with_body_ends``; without them the last window is the whole
    text, which is meant for texts of few functions.
    """
    nested = spec.nested if nested is None else nested
    pattern = F.lit(chunk_pattern(spec))

    def of(source: Column) -> Column:
        return F.struct(source.alias("source"), F.length(source).alias("size"))

    def entries(chunks: Column, ends: Column | None) -> Column:
        if spec.body == "indent":
            found = F.regexp_extract_all(text, pattern, F.lit(1))
            return F.zip_with(chunks, found, lambda chunk, source: describe(chunk, lambda _: of(source)))
        return F.transform(
            chunks,
            lambda chunk, index: describe(
                chunk, lambda sig: brace_function(spec, chunks, index, sig, compat, ends)
            ),
        )

    def describe(chunk: Column, body) -> Column:
        def entry(signature: Column) -> Column:
            is_function = signature != ""
            return F.struct(
                F.when(is_function, name_of(spec, signature)).alias("name"),
                F.when(is_function, body(signature)).otherwise(of(F.lit(""))).alias("body"),
                F.length(chunk).alias("size"),
                newlines(chunk).alias("breaks"),
            )

        return let(signature_of(spec, chunk), entry)

    def step(state: Column, entry: Column) -> Column:
        told = entry["body"]["size"]
        size = F.when(told < 0, state["total"] - state["offset"]).otherwise(told)
        kept = size > 0
        if not nested:
            kept = kept & (state["offset"] >= state["covered"])
        item = F.struct(
            entry["name"].alias("function_name"),
            entry["body"]["source"].alias("source"),
            state["breaks"].alias("first_line"),
            state["index"].alias("index"),
            size.alias("size"),
        )
        return F.struct(
            state["total"].alias("total"),
            (state["index"] + 1).alias("index"),
            (state["offset"] + entry["size"]).alias("offset"),
            (state["breaks"] + entry["breaks"]).alias("breaks"),
            F.when(kept, state["offset"] + size).otherwise(state["covered"]).alias("covered"),
            F.when(kept, F.array_append(state["found"], item)).otherwise(state["found"]).alias("found"),
        )

    item_type = "array<struct<function_name:string,source:string,first_line:int,index:int,size:int>>"

    def state_from(state: Column, found: Column) -> Column:
        return F.struct(*(state[c].alias(c) for c in ("total", "index", "offset", "breaks", "covered")), found.alias("found"))

    # Appending copies an array, so blocks keep the appended ones short; a file
    # of very many functions then costs little more than its length.
    def step_block(listed: Column):
        def step_from(state: Column, first: Column) -> Column:
            here = state_from(state, F.array().cast(item_type))
            block = F.aggregate(F.slice(listed, first, _block(listed)), here, step)
            return let(block, lambda done: state_from(done, F.array_append(state["found"], done["found"])))

        return step_from

    # The length is counted once, and not at every step.
    zeros = F.struct(F.length(text).alias("total"), *(F.lit(0).alias(c) for c in ("index", "offset", "breaks", "covered")))
    start = state_from(zeros, F.array().cast(f"array<{item_type}>"))

    def fold(listed: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(listed), F.lit(1)), _block(listed))
        return F.aggregate(firsts, start, step_block(listed), lambda state: F.flatten(state["found"]))

    def found_in(chunks: Column, ends: Column | None) -> Column:
        def with_text(item: Column) -> Column:
            # Only functions that are kept get their text, from the chunks they reach.
            last, index = F.size(chunks), item["index"]
            if ends is not None:
                upto = F.get(ends, index)["offset"] + item["size"]
                last = F.when(ends.isNull(), last).otherwise(_first_at_least(ends, upto, lambda x: x["offset"]))
            source = F.substring(_joined(chunks, index + 1, last - index), F.lit(1), item["size"])
            return let(
                F.coalesce(item["source"], source) if spec.body != "indent" else item["source"],
                lambda source: F.struct(
                    item["function_name"].alias("function_name"), source.alias("source"),
                    item["first_line"].alias("first_line"), newlines(source).alias("lines"),
                ),
            )

        return F.transform(let(entries(chunks, ends), fold), with_text)

    if chunks is not None and spec.body != "indent":
        return found_in(chunks, ends)
    return let(signature_chunks(spec, text), lambda parts: found_in(parts, None))

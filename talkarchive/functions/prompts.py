"""The sections of a summary prompt as column functions; a section without text is left out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clock


def slide_line(at: Column, title: Column, content: Column, points: Column) -> Column:
    """One slide: its time and title, 500 characters of its content and 5 of its points."""
    body = F.nullif(F.substring(content, 1, 500), F.lit(""))
    list_ = F.nullif(F.array_join(F.slice(points, 1, 5), "; "), F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("- "), clock(at), F.lit(" "), title), body, list_)


def window_budgets(n: Column) -> tuple[Column, Column]:
    """Frames and characters of visual context for each of n windows."""
    return F.greatest(F.lit(5), F.floor(60 / n).cast("int")), F.greatest(F.lit(1000), F.floor(8000 / n).cast("int"))


def prompt(title: Column, part: Column, parts: Column, start: Column, end: Column, spoken: Column, slides: Column, visual: Column, audio: Column) -> Column:
    where = F.when(parts > 1, F.concat(F.lit("Part "), part.cast("string"), F.lit(" of "), parts.cast("string"), F.lit(" ("), clock(start), F.lit(" - "), clock(end), F.lit(")")))
    named = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}:\n"), c))
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), title), where)
    return F.concat_ws("\n\n", head, named("Transcript", spoken), named("Slides", slides), named("Visual context", visual), named("Audio", audio))


def audio_section(summary: Column, primary: Column, supporting: Column, hints: Column, seen: Column) -> Column:
    """The audio part of a prompt; empty where nothing is known.

    summary: the classifier's sentences; primary: struct(label, confidence, score, hint); supporting: array of
    struct(label, key, hint); hints: further hints, of which two that are said nowhere else stay; seen: hints from frames.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    some = lambda c, or_: F.coalesce(F.nullif(c, F.lit("")), or_)
    none = F.array().cast("array<string>")
    # The lines that the prompt takes.
    opening = F.lit("Use these cues as supporting evidence only. Prefer transcript and visuals if they conflict.")
    said = F.when(text(summary) != "", F.concat(F.lit("- Classifier summary: "), text(summary)))
    score = F.when(primary["score"].isNotNull(), F.concat(F.lit(", score "), F.format_string("%.2f", primary["score"].cast("double")))).otherwise("")
    main = F.when(primary.isNotNull(), F.concat(F.lit("- Primary classification: "), some(primary["label"], F.lit("unknown audio context")), F.lit(" ("), some(primary["confidence"], F.lit("unspecified")), F.lit(" confidence"), score, F.lit(").")))
    names = F.transform(supporting, lambda s: some(s["label"], some(s["key"], F.lit("unknown cue"))))
    cues = F.when(F.size(supporting) > 0, F.concat(F.lit("- Supporting classifier cues: "), F.array_join(names, ", "), F.lit(".")))
    known = F.concat(F.array(primary["hint"]), F.coalesce(F.transform(supporting, lambda s: s["hint"]), none))
    other = F.array_distinct(F.filter(F.transform(F.coalesce(hints, none), lambda h: text(h)), lambda h: h != ""))
    other = F.slice(F.array_except(other, F.filter(known, lambda h: h.isNotNull())), 1, 2)
    line = lambda head, c: F.transform(c, lambda h: F.concat(F.lit(head), h))
    lines = F.concat(F.filter(F.array(said, main, cues), lambda x: x.isNotNull()), line("- Additional audio hint: ", other), line("- Visual corroboration: ", F.coalesce(seen, none)))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(opening), lines), "\n")).otherwise("")

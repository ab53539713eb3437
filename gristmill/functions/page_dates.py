"""Days that a page names: when it was posted and changed, periods of events and applications."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

from gristmill.functions.dom import Tree

# Labels of days and periods, how far a day may stand behind its label, and what is cut off before days are sought anywhere.
POSTED_LABELS = ["등록일", "작성일", "게시일", "등록일자", "작성일자", "게시일자"]
MODIFIED_LABELS = ["수정일", "최종수정일", "수정일자"]
EVENT_LABEL = re.compile(r"행사\s*일|개최\s*일|행사\s*일시|개최\s*일시|행사\s*기간|개최\s*기간")
APPLICATION_LABEL = re.compile(r"신청\s*기간|접수\s*기간|모집\s*기간|프로그램\s*기간|행사\s*기간|운영\s*기간|접수\s*일정|교육\s*기간")
LABEL_REACH, EVENT_REACH, APPLICATION_REACH = 200, 240, 220
LONG_PAGE, LEAST_TAIL, MOST_TAIL, TAIL_SHARE = 12_000, 6_000, 25_000, 5
FIRST_YEAR, FIRST_PERIOD_YEAR, LAST_PERIOD_YEAR = 1900, 1990, 2100

#: A day with separators or Korean units, and one of eight digits.
_DAY = re.compile(r"(\d{4})\s*(?:[-/]\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})|\.\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})|년\s*(\d{1,2})월\s*(\d{1,2})일)")
_DIGITS = re.compile(r"(\d{4})(\d{2})(\d{2})")
_YEAR = re.compile(r"(?<!\w)(?:19|20)\d{2}(?!\w)")
#: What may stand between the two days of a period, weekdays and times of day included.
_BETWEEN = re.compile(r"\s*일?\.?\s*(?:\([^)]{1,6}\))?\s*(?:\d{1,2}:\d{2}(?::\d{2})?)?\s*(?:부터)?\s*(?:~|∼|～|-|–|—|에서)?\s*")
#: A second day without its year, or without year and month.
_SHORT = re.compile(r"(?:(\d{1,2})\s*(?:[-/.]|월)\s*)?(\d{1,2})(?!\s*(?:[:\d]|시|명|회|개|월|년))")
_MARK = re.compile(r"[~∼～–—-]|부터|에서")


def day(year: object, month: object, of_month: object, now: dt.date) -> dt.date | None:
    """A valid day from 1900 to today, else nothing."""
    try:
        found = dt.date(int(year), int(month), int(of_month))
    except ValueError:
        return None
    return found if found.year >= FIRST_YEAR and found <= now else None


def _parts(m: re.Match) -> tuple[str, str, str]:
    return m[1], m[2] or m[4] or m[6], m[3] or m[5] or m[7]


def days(text: str, now: dt.date) -> list[dt.date]:
    """The full days of a text that aren't in the future, in order."""
    return [d for m in _DAY.finditer(text) if (d := day(*_parts(m), now))]


def periods(text: str) -> Iterator[tuple[dt.date, dt.date]]:
    """(start, end) of the periods of a text, days to come included; an end may lack its year, or year and month. A day alone starts and ends its own."""
    at = 0
    while m := _DAY.search(text, at):
        at = m.end()
        try:
            start = dt.date(*map(int, _parts(m)))
        except ValueError:
            continue
        end = start
        gap = _BETWEEN.match(text, at)
        if gap and _MARK.search(gap[0]):
            full, short = _DAY.match(text, gap.end()), _SHORT.match(text, gap.end())
            try:
                if full:
                    end, at = dt.date(*map(int, _parts(full))), full.end()
                elif short:
                    month = int(short[1] or start.month)
                    end, at = dt.date(start.year + (month < start.month), month, int(short[2])), short.end()
            except ValueError:
                pass
        if end >= start:
            yield start, end


def _valued(tree: Tree, label: re.Pattern, tags: tuple[str, ...]) -> Iterator[str]:
    """The text of each cell that holds a label, with that of the value beside it."""
    for cell in tree.within(0, tags):
        said = tree.text(cell)
        if said and label.search(said):
            beside = next((k for k in tree.children(tree.parent[cell]) if k > cell and tree.tag[k] in ("td", "dd")), None)
            yield f"{said} {tree.text(beside)}" if beside is not None else said


def _labelled(tree: Tree, labels: list[str], now: dt.date) -> dt.date | None:
    """The day of the first definition with one of the labels; else the latest of those that follow a label in the page's source."""
    for term in tree.by_tag.get("dt", ()):
        if any(x in tree.text(term) for x in labels):
            value = next((k for k in tree.children(tree.parent[term]) if k > term and tree.tag[k] == "dd"), None)
            text = tree.text(value) if value is not None else ""
            if found := next(iter(days(text, now)), None) or next((d for m in _DIGITS.finditer(text) if (d := day(*m.groups(), now))), None):
                return found
    near = []
    for m in re.finditer("|".join(sorted(labels, key=len, reverse=True)), tree.source):
        gap = re.compile(rf"[^0-9]{{0,{LABEL_REACH}}}").match(tree.source, m.end())
        found = _DAY.match(tree.source, gap.end()) or _DIGITS.match(tree.source, gap.end())
        if found and (d := day(*(_parts(found) if found.re is _DAY else found.groups()), now)):
            near.append(d)
    return max(near, default=None)


def _near(tree: Tree, label: re.Pattern, reach: int) -> Iterator[str]:
    """What stands near a label: cells with their values, then the text that follows it."""
    yield from _valued(tree, label, ("th", "td", "dt"))
    text = tree.text(0)
    yield from (text[m.start():m.start() + reach] for m in label.finditer(text))


def event_start(tree: Tree, now: dt.date) -> dt.date | None:
    """The earliest day near the first label of an event that has one."""
    return next((min(found) for text in _near(tree, EVENT_LABEL, EVENT_REACH) if (found := days(text, now))), None)


def application_year(tree: Tree, now: dt.date) -> dt.date | None:
    """The first of January of the earliest year near the first label of a period of applications that has one."""
    for text in _near(tree, APPLICATION_LABEL, APPLICATION_REACH):
        years = [d.year for d in days(text, now)] or [y for m in _YEAR.finditer(text) if FIRST_PERIOD_YEAR <= (y := int(m[0])) <= LAST_PERIOD_YEAR]
        if years and (found := day(min(years), 1, 1, now)):
            return found
    return None


def labelled_period(tree: Tree, label: re.Pattern, reach: int) -> tuple[dt.date, dt.date] | None:
    """The first period near a label."""
    return next((p for text in _near(tree, label, reach) for p in periods(text)), None)


def post_date(tree: Tree, now: dt.date, events: bool = False) -> tuple[dt.date | None, str]:
    """(day, source) of a page: posted, modified, event, application, or any day of it, the latest; events and applications only if asked for."""
    for labels, source in ((POSTED_LABELS, "posted"), (MODIFIED_LABELS, "modified")):
        if found := _labelled(tree, labels, now):
            return found, source
    if events:
        if found := event_start(tree, now):
            return found, "event"
        if found := application_year(tree, now):
            return found, "application"
    text = tree.source
    if len(text) >= LONG_PAGE:
        text = text[:-min(MOST_TAIL, max(LEAST_TAIL, len(text) // TAIL_SHARE))]
    found = max(days(text, now), default=None)
    return found, "any" if found else ""


def page_dates(tree: Tree, now: dt.date) -> dict:
    """What ``post_date`` finds with events, the day of the last change, and the periods of an event and of applications."""
    found, source = post_date(tree, now, True)
    event = labelled_period(tree, EVENT_LABEL, EVENT_REACH) or (None, None)
    application = labelled_period(tree, APPLICATION_LABEL, APPLICATION_REACH) or (None, None)
    return {"day": found, "source": source, "modified": _labelled(tree, MODIFIED_LABELS, now), "event_start": event[0], "event_end": event[1],
            "apply_start": application[0], "apply_end": application[1]}

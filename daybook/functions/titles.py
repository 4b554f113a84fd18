"""Which application a window belongs to, and what it is used for."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.text import bound
from daybook.schema import CATEGORIES, MOODS

#: Process names that tell nothing about the application.
GENERIC = tuple("electron java javaw python pythonw python3 node ruby perl dotnet applicationframehost wslhost conhost gnome-shell plasmashell cefsharp nwjs tauri msedge".split())
#: Applications of known category, in the order in which they are tried.
KNOWN = {
    **dict.fromkeys("alacritty kitty wezterm hyper iterm2 iterm terminal windowsterminal cmd powershell pwsh wt gnome-terminal konsole tilix foot st urxvt xterm".split(), "terminal"),
    **dict.fromkeys(("discord", "slack", "teams", "microsoft teams", "telegram", "whatsapp", "signal", "thunderbird", "outlook"), "communication"),
    **dict.fromkeys("anytype obsidian notion typora marktext logseq notepad wordpad libreoffice".split(), "writing"),
    **dict.fromkeys("spotify vlc mpv".split(), "media"),
    **dict.fromkeys("figma gimp inkscape".split(), "design"),
    "zoom": "meeting",
}
#: File extensions that rule out a title's last part as an application.
EXTENSIONS = tuple("py js ts rs go java c cpp h rb php cs kt swift lua sh bash zsh ps1 html css json yaml yml toml xml ini cfg conf txt md log csv pdf doc docx xls xlsx ppt pptx mp4 mkv avi mov webm mp3 flac wav ogg png jpg jpeg gif svg bmp webp ico".split())
#: How browsers end their titles, and their process names.
BROWSER_TITLES = ("- Google Chrome", "- Mozilla Firefox", "- Firefox", "- Microsoft Edge", "- Brave", "- Opera", "- Safari", "- Vivaldi", "- Arc", "- Chromium", "- Zen Browser")
BROWSERS = tuple("chrome chromium firefox firefox-esr brave opera safari vivaldi arc msedge".split())
#: Signs that a title names content rather than an application.
NO_SIMPLE_TITLE = ("/", "\\", "@", ":", "$", "#", "~", ".txt", ".py", ".js", ".ts", ".rs", ".go", ".html", ".css", ".md", ".json", ".yaml")
#: Process names and title endings that tell of coding.
CODING_APPS = ("code", "code - insiders", "devenv", "idea64", "pycharm64", "webstorm64", "goland64", "sublime_text", "atom", "notepad++", "windowsterminal", "cmd", "powershell", "pwsh", "wt", "mintty", "git-bash", "alacritty", "wezterm")
CODING_TITLES = (".py", ".js", ".ts", ".go", ".rs", ".java", ".cpp", ".c", ".html", ".css", ".jsx", ".tsx", ".vue", ".rb", ".php", "visual studio code", "vs code", "pycharm", "intellij", "terminal", "powershell", "cmd.exe", "git ", "npm ", "pip ", "python ", "node ")


def _any(text: Column, values: tuple[str, ...], where: str = "%s") -> Column:
    """Whether one of fixed ``values`` is in a text, by one pattern that is compiled once; ``where`` holds it to a place."""
    return F.rlike(text, F.lit(where % f"(?:{'|'.join(map(re.escape, values))})"))


def app_from_title(title: Column) -> Column:
    """The last part of ``document - App``, tried with hyphen, en dash and em dash."""
    options = []
    for dash in (" - ", " – ", " — "):
        last = F.trim(F.substring_index(title, dash, -1))
        named = F.contains(title, F.lit(dash)) & F.length(last).between(2, 40)
        is_file = F.contains(last, F.lit(".")) & F.lower(F.substring_index(last, ".", -1)).isin(*EXTENSIONS)
        options.append(F.when(named & ~is_file, last))
    return F.coalesce(*options)


def simple_title(title: Column) -> Column:
    """A short title without signs of content is the application's name."""
    t = F.trim(title)
    low = F.lower(t)
    content = _any(low, NO_SIMPLE_TITLE) | _any(low, ("untitled", "new ", "document"), "^%s")
    return F.when((t != "") & (F.length(t) <= 25) & ~content, t)


def _word_in(word: Column, text: Column) -> Column:
    """Whether ``word`` occurs in ``text`` between word boundaries."""
    quoted = F.regexp_replace(word, r"([^A-Za-z0-9_\s])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit("(?U)\\b"), quoted, F.lit("\\b")))


def is_more_specific(name: Column, other: Column) -> Column:
    """Whether ``other`` is longer and contains ``name`` as a word; both in lower case.
    A pattern of its own is made only for a name that the other contains."""
    return (F.length(other) > F.length(name)) & F.contains(other, name) & _word_in(name, other)


def is_browser(title: Column, hint: Column) -> Column:
    ends = F.coalesce(_any(title, BROWSER_TITLES, r"%s\z"), F.lit(False))
    return ends | F.coalesce(F.lower(F.trim(hint)).isin(*BROWSERS), F.lit(False))


def known_category(app: Column) -> Column:
    """Exact name, then prefixes either way, then a word of the name; the first rule in order wins."""
    runs = [(kind, tuple(k for k, _ in run)) for kind, run in groupby(KNOWN.items(), lambda r: r[1])]  # one test for neighbours of a category

    def kind_of(name: Column) -> Column:
        first = lambda test: [F.when(test(names), F.lit(kind)) for kind, names in runs]
        begun = lambda names: {k[:n] for k in names for n in range(max(5, len(k) - 3), len(k) + 1)}  # noqa: E731  what a rule's name may be cut to
        prefix = lambda names: _any(name, names, "^%s") | (name.isin(*sorted(begun(names))) if begun(names) else F.lit(False))
        return F.coalesce(*first(lambda names: name.isin(*names)), *first(prefix), *first(lambda names: _any(name, names, r"(?U)\b%s\b")))

    return bound(F.regexp_replace(F.lower(F.trim(app)), r"[-. ]+$", ""), kind_of)


def _declared(value: Column, names: tuple[str, ...], otherwise: str) -> Column:
    """The first declared name that the value contains."""
    return bound(F.lower(F.trim(F.coalesce(value, F.lit("")))), lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(n)), n) for n in names], F.lit(otherwise)))


def category(value: Column) -> Column:
    return _declared(value, CATEGORIES, "other")


def mood(value: Column) -> Column:
    return _declared(value, MOODS, "neutral")


def reconcile(app: Column, raw_category: Column, hint: Column, title: Column) -> Column:
    """``struct<app_name, category>`` from a model's guess, the process name and the window title."""
    said = F.coalesce(app, F.lit(""))
    process = F.when((F.coalesce(hint, F.lit("")) != "") & ~F.lower(F.trim(hint)).isin(*GENERIC), hint)
    by_name = lambda name: F.when(is_browser(title, hint), category(raw_category)).otherwise(F.coalesce(known_category(name), category(raw_category)))

    def named(found: Column) -> Column:
        keep = F.coalesce(is_more_specific(F.lower(F.trim(found)), F.lower(F.trim(said))), F.lit(False))
        return F.when(found.isNull() | keep, said).otherwise(found)

    # the name is worked out once, not for each rule that looks at it
    name = bound(F.coalesce(app_from_title(title), process, simple_title(title)), named)
    return bound(name, lambda name: F.struct(name.alias("app_name"), by_name(name).alias("category")))


def is_coding(kind: Column, app: Column, title: Column) -> Column:
    """By category, by process name, or by the window title."""
    by_app = F.replace(F.lower(app), F.lit(".exe"), F.lit("")).isin(*CODING_APPS)
    by_title = _any(F.lower(title), CODING_TITLES)
    return F.coalesce(F.lower(kind).isin("coding", "terminal"), F.lit(False)) | F.coalesce(by_app, F.lit(False)) | F.coalesce(by_title, F.lit(False))

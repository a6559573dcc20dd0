"""Finding the files of a corpus: globs, size and type filters, ignore files. Listing is the driver's; reading is not."""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass, field

# Folders and files left out by default, and suffixes of files that are not text.
SKIP_DIRS = frozenset(".git .sem .venv venv node_modules __pycache__ .hg .svn .mypy_cache .pytest_cache .tox .idea".split())
SKIP_FILES = frozenset([".DS_Store"])
BINARY = frozenset(
    ".png .jpg .jpeg .gif .webp .ico .bmp .tiff .heic .mp3 .mp4 .mov .avi .wav .flac .zip .gz .tgz .bz2 .xz .7z .rar .tar "
    ".dmg .pkg .exe .dll .so .dylib .o .a .class .jar .pyc .whl .npy .npz .safetensors .bin .pt .onnx .sqlite .db .woff "
    ".woff2 .ttf .otf .eot .psd .sketch .key .numbers .pages .docx .xlsx .pptx .parquet .arrow .feather".split()
)
MOST_BYTES = 50 << 20


@dataclass
class Rule:
    """One line of an ignore file."""

    regex: re.Pattern
    keep: bool
    folders: bool


def _class(body: str) -> str:
    body = body.replace("\\", r"\\")
    return f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"


#: Parts of an ignore pattern and what each stands for.
_PART = re.compile(r"(?P<deep>\*\*/)|(?P<any>\*\*)|(?P<star>\*)|(?P<one>\?)|\[(?P<set>[^\]]+)\]|(?P<char>.)", re.DOTALL)
_MEANS = {"deep": "(?:.*/)?", "any": ".*", "star": "[^/]*", "one": "[^/]"}


def ignore_rules(text: str) -> list[Rule]:
    """The rules of an ignore file, in order."""
    rules = []
    for line in map(str.rstrip, text.splitlines()):
        if not line or line[0] == "#":
            continue
        keep, line = (True, line[1:]) if line[0] == "!" else (False, line)
        line = line[1:] if line[:1] == "\\" else line
        bare = line.rstrip("/")
        if not bare:
            continue
        body = "".join(_MEANS.get(m.lastgroup) or (_class(m["set"]) if m["set"] else re.escape(m["char"])) for m in _PART.finditer(bare.lstrip("/")))
        rules.append(Rule(re.compile(("" if "/" in bare else "(?:.*/)?") + body, re.DOTALL), keep, line.endswith("/")))
    return rules


def is_ignored(path: str, folder: bool, layers: list[tuple[str, list[Rule]]]) -> bool:
    """The last rule that fits decides; layers: (folder, its rules), from the top down; paths are absolute."""
    verdict = False
    for base, rules in layers:
        prefix = base.rstrip("/") + "/"
        if path.startswith(prefix):
            for r in rules:
                if (folder or not r.folders) and r.regex.fullmatch(path[len(prefix) :]):
                    verdict = not r.keep
    return verdict


def shown_path(path: str, base: str | None = None) -> str:
    """The path from the working folder if it lies in it, else the absolute one."""
    path, base = os.path.realpath(path), os.path.realpath(base or os.getcwd())
    return os.path.relpath(path, base).replace(os.sep, "/") if path == base or path.startswith(base.rstrip("/") + "/") else path


def _fits(path: str, globs: list[str]) -> bool:
    return any(fnmatch.fnmatch(x, g) for g in globs for x in (path, os.path.basename(path)))


def verdict(shown: str, size: int, named: bool = False, include: list[str] = (), exclude: list[str] = (), most_bytes: int = MOST_BYTES) -> str:
    """What becomes of a file: ``take``, ``leave``, or ``large``. named: it is a root itself."""
    name = os.path.basename(shown)
    if _fits(shown, list(exclude)) or not named and (name in SKIP_FILES or include and not _fits(shown, list(include))):
        return "leave"
    if size > most_bytes:
        return "large"
    return "leave" if os.path.splitext(name)[1].lower() in BINARY else "take"


@dataclass
class Found:
    """(shown path, real path, size, mtime) of each file, and notes on files that are too large."""

    files: list[tuple[str, str, int, float]] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def discover(roots: list[str], include: list[str] = (), exclude: list[str] = (), most_bytes: int = MOST_BYTES, use_ignore: bool = True) -> Found:
    """Files under the roots, each once, in the order of a walk by name. Linked folders are not entered."""
    found, seen = Found(), set()

    def take(path: str, named: bool) -> None:
        real = os.path.realpath(path)
        shown = shown_path(real)
        try:
            stat = os.stat(real)
        except OSError:
            return
        # names are those of the link, if it is one, paths those of the file
        what = "leave" if real in seen else verdict(shown, stat.st_size, named, include, exclude, most_bytes)
        if os.path.basename(path) != os.path.basename(real) and what == "take":
            what = verdict(os.path.basename(path), 0, True)
        if what == "large":
            found.skipped.append(f"{shown} (over {most_bytes >> 20} MB)")
        elif what == "take":
            seen.add(real)
            found.files.append((shown, real, stat.st_size, stat.st_mtime))

    def rules_of(folder: str) -> list[tuple[str, list[Rule]]]:
        try:
            with open(os.path.join(folder, ".gitignore"), errors="replace") as f:
                return [(folder, ignore_rules(f.read()))] if use_ignore else []
        except OSError:
            return []

    for root in roots:
        start = os.path.realpath(os.path.expanduser(root))
        if not os.path.exists(start):
            raise FileNotFoundError(f"path not found: {root}")
        if os.path.isfile(start):
            take(os.path.expanduser(root), True)
            continue
        above, here = [], os.path.realpath(os.getcwd())
        if start == here or start.startswith(here.rstrip("/") + "/"):  # ignore files from the working folder down
            while here != start:
                above += rules_of(here)
                here = os.path.join(here, os.path.relpath(start, here).split(os.sep)[0])
        todo = [(start, above)]
        while todo:
            path, layers = todo.pop()
            if os.path.isdir(path) and not (os.path.islink(path) and path != start):
                layers = layers + rules_of(path)
                try:
                    entries = sorted(os.scandir(path), key=lambda e: e.name, reverse=True)
                except OSError:
                    continue
                for e in entries:
                    folder = e.is_dir(follow_symlinks=False)
                    if folder and (e.name in SKIP_DIRS or _fits(shown_path(e.path), list(exclude))):
                        continue
                    if not (folder or e.is_file()) or is_ignored(e.path, folder, layers):
                        continue
                    todo.append((e.path, layers))
            elif os.path.isfile(path):
                take(path, False)
    return found


def listing(spark, found: Found):
    """The files as a table: path, file, size, mtime."""
    return spark.createDataFrame(found.files, "path string, file string, size long, mtime double")

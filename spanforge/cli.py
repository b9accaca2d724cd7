"""Plans on the command line.

    python -m spanforge.cli partition FILE --parts N [--delimiter-byte B] [--worker K]
    python -m spanforge.cli partition-files --parts N [--delimiter-byte B] FILE...

Prints tab-separated numbers without a header: index, start, end, length; or worker, source, start, end, length.
Nothing is printed unless the whole plan is made.
"""

from __future__ import annotations

import sys

from . import __version__
from .plans.files import plan_file, plan_files
from .sources.tsv import ranges_tsv, worker_ranges_tsv


class Usage(ValueError):
    """The command line is not understood."""


def _number(text: str, what: str, most: int | None = None) -> int:
    if not (text.isascii() and text.isdigit()):
        raise Usage(f"{what} must be a decimal number")
    value = int(text)
    if most is not None and value > most:
        raise Usage(f"{what} must be at most {most}")
    return value


def _parsed(args: list[str], allowed: set[str]) -> tuple[dict[str, str], list[str]]:
    options: dict[str, str] = {}
    files, at = [], 0
    while at < len(args):
        a = args[at]
        if a in allowed:
            if a in options:
                raise Usage(f"{a} is given twice")
            if at + 1 >= len(args):
                raise Usage(f"{a} needs a value")
            options[a] = args[at + 1]
            at += 2
        elif a.startswith("-"):
            raise Usage(f"unexpected option {a}")
        else:
            files.append(a)
            at += 1
    return options, files


def run(args: list[str]) -> str:
    if args in (["--help"], ["-h"]) or args[1:] in (["--help"], ["-h"]) and args[0] in ("partition", "partition-files"):
        return __doc__ or ""
    if args in (["--version"], ["-V"]):
        return f"spanforge {__version__}\n"
    if not args:
        raise Usage("missing command")
    command, rest = args[0], args[1:]
    if command not in ("partition", "partition-files"):
        raise Usage(f"unknown command {command}")
    one = command == "partition"
    options, files = _parsed(rest, {"--parts", "--delimiter-byte", *(["--worker"] if one else [])})
    if not files or one and len(files) > 1:
        raise Usage("one FILE is needed" if one else "at least one FILE is needed")
    if "--parts" not in options:
        raise Usage("--parts is needed")
    parts = _number(options["--parts"], "--parts")
    if not parts:
        raise Usage("--parts must be positive")
    delimiter = _number(options.get("--delimiter-byte", "10"), "--delimiter-byte", 255)
    if not one:
        return worker_ranges_tsv(plan_files(files, parts, delimiter))
    worker = _number(options["--worker"], "--worker", parts - 1) if "--worker" in options else None
    ranges = plan_file(files[0], parts, delimiter).ranges
    return ranges_tsv(r for r in ranges if worker in (None, r.index))


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
    except (Usage, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2 if isinstance(e, Usage) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

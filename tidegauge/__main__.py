"""python -m tidegauge GATE... DIR: print the gates over the tables of DIR; exit code 1 if one fails."""

from __future__ import annotations

import sys

from tidegauge.plans import reference
from tidegauge.session import get_session

GATES = ("vintage_panel", "market_close", "indicator_meta")


def main(arguments: list[str]) -> int:
    if not arguments or set(arguments[:-1]) - set(GATES):
        print(f"{__doc__}\nGATE: {' '.join(GATES)}; none means all", file=sys.stderr)
        return 2
    wanted = arguments[:-1] or list(GATES)
    report = reference.gate_report(get_session("gates"), arguments[-1])
    rows = [r for r in report.collect() if r["gate"] in wanted]
    for r in rows:
        print(f"{'ok  ' if r['passed'] else 'FAIL'} {r['gate']}: {r['check_name']} ({r['rows_checked']} rows)")
    return 0 if all(r["passed"] for r in rows) else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

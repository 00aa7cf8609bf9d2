"""A line shell: ``python -m fathom.shell [database folder]``."""

from __future__ import annotations

import sys

from fathom.ask import to_sql
from fathom.session import Engine, connect

HELP = ".help .quit .tables .schema NAME .version .open FOLDER .clear .ask SOURCE QUESTION; else SQL, ended by ;"


def command(db: Engine, line: str) -> str | None:
    """The answer to a dot-command; None to stop."""
    name, _, rest = line.partition(" ")
    if name == ".quit":
        return None
    if name == ".help":
        return HELP
    if name == ".tables":
        return "\n".join(r[0] for r in db.sql("SHOW TABLES").fetchall())
    if name == ".schema":
        return "\n".join(f"{r[0]} {r[1]}" for r in db.sql(f"DESCRIBE {rest}").fetchall())
    if name == ".version":
        return "fathom 0.1.0"
    if name == ".clear":
        return "\033[2J\033[H"
    if name == ".ask":
        source, _, question = rest.partition(" ")
        columns = dict(db.query(f"SELECT * FROM {source}").dtypes)
        sql = to_sql(question, source, columns)
        return sql + "\n" + "\n".join(map(str, db.sql(sql).fetchall()))
    return f"unknown command {name}; {HELP}"


def main() -> None:
    db, held = connect(sys.argv[1] if len(sys.argv) > 1 else None), ""
    for line in sys.stdin:
        try:
            if line.startswith(".open "):
                db.close()
                db = connect(line[6:].strip())
            elif line.startswith(".") and not held:
                answer = command(db, line.strip())
                if answer is None:
                    break
                print(answer)
            else:
                held += line
                if held.rstrip().endswith(";"):
                    sql, held = held, ""
                    db.sql(sql).show()
        except Exception as e:  # noqa: BLE001 - a shell goes on after a failed statement
            print(f"error: {e}")
            held = ""
    db.close()


if __name__ == "__main__":
    main()

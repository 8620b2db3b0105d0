"""A small console: python -m marlstone.cli DATABASE."""

from __future__ import annotations

import argparse
import shlex
import sys
import time

from pyspark.sql import SparkSession

from marlstone.errors import MarlstoneError
from marlstone.functions.types import comparison
from marlstone.sources.catalog import Database

HELP = """use PATH              open a database
search QUERY          run a query and print its rows
execute QUERY         parse a query and print it
display               print the tables
display T.C OP VALUE  count the rows of table T whose column C compares with VALUE
index T.C             print the size of the index of a column
keys T.C              print its keys with their numbers of rows
rows T N              print N rows
record T              print the record type of a table
clear, help, quit"""


class Console:
    def __init__(self, spark: SparkSession, db: Database | None = None, out=sys.stdout):
        self.spark, self.db, self.out = spark, db, out

    def say(self, line: str) -> None:
        print(line, file=self.out)

    def run(self, line: str) -> bool:
        """Run a command; false ends the console."""
        name, _, rest = line.strip().partition(" ")
        if name in ("quit", "exit", "kill"):
            return False
        try:
            if name == "help":
                self.say(HELP)
            elif name == "clear":
                self.say("\033[2J\033[H")
            elif name in ("use", "mount"):
                began = time.time()
                self.db = Database.open(self.spark, shlex.split(rest)[0])
                self.say(f"opened in {1000 * (time.time() - began):.0f} ms")
            elif name and self.db is None:
                self.say("no database: use PATH")
            elif name == "search":
                self.print(self.db.sql(rest))
            elif name == "execute":
                self.say(self.db.parse(rest).to_sql())
            elif name == "display" and not rest:
                self.print(self.db.tables_info())
            elif name == "display":
                column, operator, value = shlex.split(rest)
                self.say(str(self.db.compare(column, comparison(operator), value).count()))
            elif name == "index":
                self.print(self.db.index_report(rest.strip()))
            elif name == "keys":
                self.print(self.db.index_groups(rest.strip()).orderBy("key"))
            elif name == "rows":
                table, n = shlex.split(rest)
                self.print(self.db.scan(table, ordered=True).limit(int(n)))
            elif name == "record":
                self.say(self.db.table_meta(rest.strip()).schema().simpleString())
            elif name:
                self.say(f"no command {name}")
        except (MarlstoneError, ValueError) as error:
            self.say(f"error: {error}")
        return True

    def print(self, df) -> None:
        from marlstone.render import pages

        for page in pages(df, numbers=True):
            self.say(page)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("database", nargs="?")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("console").getOrCreate()
    console = Console(spark, Database.open(spark, options.database) if options.database else None)
    for line in sys.stdin:
        if not console.run(line):
            break


if __name__ == "__main__":
    main()

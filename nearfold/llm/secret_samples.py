"""Labelled strings for the secret models: ordinary identifiers, paths and runs, and random strings."""

from __future__ import annotations

import random
import string

# Common words of identifiers and paths.
WORDS = (
    "get set add remove find make build read write load save open close start stop run test check parse format "
    "convert create update delete insert select count total index list array table column row key value name type "
    "size length width height number string text byte char file path folder user group account order item page "
    "view model controller service manager handler factory client server request response message event queue "
    "thread task job worker session context config option default global local public private static final "
    "abstract interface class method function module package import export include error exception warning debug "
    "info log trace date time year month day hour minute second first last next previous current old new min max "
    "average random hash code data base node tree graph edge image color font style window button label input "
    "output source target result status state flag mode level version release branch commit merge main home index "
    "http https www com org net html json xml csv example element document attribute property"
).split()
ALPHABETS = {
    "hex": string.digits + "abcdef",
    "upper hex": string.digits + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "lower letters and digits": string.ascii_lowercase + string.digits,
    "letters and digits": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "url-safe": string.ascii_letters + string.digits + "-_",
}
# Runs along the alphabet, the digits and the keyboard are ordinary.
RUNS = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "qwertyuiop", "asdfghjkl", "zxcvbnm")


def identifiers(words: list[str], n: int, seed: int) -> list[str]:
    """Names, constants, paths, file names and dates made of the words."""
    draw, made = random.Random(seed), []
    for i in range(n):
        some = draw.choices(words, k=draw.randrange(3, 7))
        number = str(draw.choice([draw.randrange(10), draw.randrange(100), draw.randrange(1990, 2040)]))
        made.append(
            (
                "_".join(some),
                "-".join(some),
                some[0] + "".join(w.title() for w in some[1:]),
                "".join(w.title() for w in some),
                "_".join(some).upper(),
                "/".join(some),
                "/" + "/".join(some[:-1]) + "/" + "_".join(some[-1:]) + number,
                "-".join(some) + "-" + number,
                "_".join(some) + "_" + number,
                "=" * draw.randrange(3, 30) + some[0] + "-" * draw.randrange(3, 30),
                f"{number}-{draw.randrange(1, 13):02}-{draw.randrange(1, 29):02}" + "/" + "/".join(some),
                "".join(some),
            )[i % 12]
        )
    return made


def ordinary_sample(n: int = 6000, seed: int = 3) -> list[str]:
    doubled = [(r + r)[:30] for r in RUNS] + [RUNS[0] + RUNS[1] + RUNS[2], RUNS[1] + RUNS[0] + RUNS[2] + "+/"]
    return identifiers(WORDS, n, seed) + doubled * (n // 200)


def random_sample(alphabet: str, n: int = 1500, length: int = 40, seed: int = 7) -> list[str]:
    draw = random.Random(f"{seed} {alphabet}")
    return ["".join(draw.choices(alphabet, k=length)) for _ in range(n)]

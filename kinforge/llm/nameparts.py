"""What two typed person names have in common, for one pair of names; namebatch says the same over arrays of pairs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Words that are no name, suffixes, titles.
NO_NAME = frozenset("nmn nmi none unk unknown na null nil missing blank test xxx xx refused notgiven nofirstname nolastname".split())
SUFFIXES = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "v": "v", "2nd": "ii", "3rd": "iii", "4th": "iv"}
TITLES = frozenset("mr mrs ms miss dr prof rev sir hon fr sra herr frau mme mlle".split())
#: Common short forms of given names that share no beginning with them; the choice is ours.
SHORT_FORMS = {
    k: frozenset(v.split())
    for k, v in {
        "bob": "robert", "bobby": "robert", "rob": "robert", "bill": "william", "billy": "william", "will": "william", "wm": "william", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "greta": "margaret", "rita": "margaret",
        "dick": "richard", "rick": "richard", "jack": "john", "johnny": "john", "jim": "james", "jimmy": "james", "jas": "james", "ted": "theodore edward", "ned": "edward edmund", "betty": "elizabeth", "liz": "elizabeth", "beth": "elizabeth", "lisa": "elizabeth", "bess": "elizabeth", "eliza": "elizabeth",
        "tony": "anthony antonio", "hank": "henry", "harry": "henry harold", "chuck": "charles", "chas": "charles", "charlie": "charles", "kate": "katherine kathleen catherine", "kathy": "katherine kathleen catherine", "katie": "katherine kathleen catherine", "kitty": "katherine kathleen catherine", "cathy": "katherine kathleen catherine", "nancy": "ann anne",
        "molly": "mary", "polly": "mary", "sally": "sarah", "sadie": "sarah", "patty": "patricia", "patsy": "patricia", "trish": "patricia", "pat": "patricia patrick", "paddy": "patrick", "gene": "eugene", "larry": "lawrence laurence", "lori": "laura", "mike": "michael", "mick": "michael", "micky": "michael", "nick": "nicholas", "klaus": "nicholas", "sandy": "alexander alexandra sandra", "alex": "alexander alexandra", "lex": "alexander", "xander": "alexander",
        "steve": "steven stephen", "fred": "frederick alfred", "al": "albert alfred alan", "bert": "albert robert herbert gilbert", "gus": "gustavo august augustus", "tina": "christina christine", "chris": "christopher christine christina", "kit": "christopher", "topher": "christopher", "jenny": "jennifer", "jen": "jennifer", "jackie": "jacqueline", "debbie": "deborah", "becky": "rebecca", "barb": "barbara", "babs": "barbara", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy",
        "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "ginny": "virginia", "ginger": "virginia", "sue": "susan suzanne", "susie": "susan suzanne", "tess": "theresa", "terry": "theresa terence", "tracy": "theresa", "manny": "manuel emmanuel", "pepe": "jose", "paco": "francisco", "pancho": "francisco", "frank": "francis francisco franklin", "fran": "frances francis", "frankie": "frances francis", "lupe": "guadalupe", "chayo": "rosario", "beto": "alberto roberto", "nacho": "ignacio",
        "hal": "harold henry", "maddy": "madeline", "gail": "abigail", "sasha": "alexander alexandra", "sandra": "alexandra", "freddy": "frederick alfred", "freddie": "frederick alfred", "sammy": "samuel samantha", "pip": "philip", "phil": "philip", "teddy": "theodore edward", "theo": "theodore", "eddie": "edward", "vinny": "vincent", "vinnie": "vincent", "liam": "william", "joey": "joseph", "joe": "joseph", "fanny": "frances", "ronnie": "ronald", "libby": "elizabeth", "lizzie": "elizabeth", "kim": "kimberly", "suzy": "suzanne susan", "mickey": "michael", "jessie": "jessica", "pam": "pamela", "judy": "judith", "tono": "antonio", "jeff": "jeffrey geoffrey", "nell": "eleanor helen", "lexi": "alexandra", "lexie": "alexandra", "chrissy": "christine christina", "jerry": "gerald jerome", "gerry": "gerald geraldine", "charo": "rosario", "lenny": "leonard", "len": "leonard", "leo": "leonard", "ron": "ronald", "don": "donald", "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david", "jon": "jonathan", "nate": "nathan nathaniel", "matt": "matthew", "andy": "andrew", "drew": "andrew", "greg": "gregory", "ken": "kenneth", "kenny": "kenneth", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "vince": "vincent", "walt": "walter", "wally": "walter", "cindy": "cynthia", "mandy": "amanda", "sam": "samantha samuel", "gabby": "gabrielle", "abby": "abigail", "izzy": "isabella", "bella": "isabella", "belle": "isabella", "nat": "natalie", "connie": "constance", "maddie": "madeline",
    }.items()
}


@lru_cache(maxsize=200_000)
def plain(text: str) -> str:
    """Lower case, accents off, every run of other characters than letters and digits one space; apostrophes vanish."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    text = re.sub(r"(?<=\w)['’`´](?=\w)", "", text).replace("ß", "ss").replace("ø", "o").replace("ł", "l")
    return re.sub(r"[\W_]+", " ", text).strip()


@lru_cache(maxsize=500_000)
def _letters(word: str) -> int:
    mask = 0
    for c in word:
        mask |= 1 << (ord(c) & 63)
    return mask


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with transpositions of neighbours, most + 1 if it is larger than most."""
    # an edit changes at most two of the letters that occur
    if abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


@lru_cache(maxsize=100_000)
def _forms(name: str) -> tuple[str, ...]:
    return tuple(s for s, full in SHORT_FORMS.items() if name in full)


def _named(word: str) -> bool:
    """Whether a word is a short form or has one."""
    return word in SHORT_FORMS or bool(_forms(word))


def _doubled(a: str, b: str) -> bool:
    """Whether b is a with one letter written twice."""
    return len(b) == len(a) + 1 and any(a[i] == b[i + 1] and a[: i + 1] + a[i:] == b for i in range(len(a)))


@lru_cache(maxsize=300_000)
def _field_words(field: str) -> tuple[str, ...]:
    text = plain(field)
    if not text or text.replace(" ", "") in NO_NAME:
        return ()
    tokens = text.split()
    return tuple(t for i, t in enumerate(tokens) if t not in TITLES and t not in NO_NAME and not (t in SUFFIXES and (i or len(tokens) == 1) and len(t) > 1))


def words(*fields: str | None) -> list[str]:
    """The name words of some fields, without titles, suffixes and what stands for a missing name."""
    return [w for field in fields if field for w in _field_words(field)]


class Person:
    """The parsed name of a record."""

    __slots__ = ("first", "last", "rest", "middle", "other", "units", "names", "joined", "fields")

    def __init__(self, fname, mname, lname, altlname, suffix=None):
        self.first, self.last, self.rest, self.middle, self.other = words(fname), words(lname), words(suffix), words(mname), words(altlname)
        self.units = [f for f in (self.first, self.last, self.rest) if f]
        self.names = [t for f in self.units for t in f] + self.other + self.middle
        self.fields = ["".join(f) for f in (*self.units, self.other, self.middle) if f]
        self.joined = [*self.names, *("".join(f) for f in (*self.units, self.other, self.middle) if len(f) > 1)]


class Speller:
    """Compares name words and whole names. Names that many records bear are established: two different established
    names aren't typos of each other, however close they are."""

    def __init__(self, established):
        self.established = established
        self.known: dict[tuple[str, str], float] = {}

    def alike(self, a: str, b: str) -> float:
        """How far two name words can be spellings of one name, 0 to 1: equal, a typo, cut short, an initial, a short form."""
        if a == b:
            return 1.0
        key = (a, b) if a < b else (b, a)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 600_000:
                self.known.clear()
            got = self.known[key] = self._alike(*key)
        return got

    def _alike(self, a: str, b: str) -> float:
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return 0.0
        if len(a) == 1:
            return 0.6 if a == b[0] else 0.0
        short = SHORT_FORMS.get(a, frozenset()), SHORT_FORMS.get(b, frozenset())
        if b in short[0] or a in short[1] or short[0] & short[1]:
            return 0.8
        if len(a) <= 3 and b.startswith(a):
            return 0.8 if len(a) == 3 else 0.65
        if a in self.established and b in self.established and not _doubled(a, b):
            return 0.0
        d = edits(a, b, 2)
        if len(b) <= 4 and d == 2:
            return 0.5 if a[0] == b[0] and len(a) > 2 else 0.0
        if d <= 2 and (a[0] == b[0] or d == 1 or len(a) >= 6):
            return 1 - 0.12 * d - (0.1 if a[0] != b[0] else 0)
        if b.startswith(a):
            return 0.8
        if len(a) >= 4 and a[0] == b[0] and edits(a, b[: len(a)], 1) <= 1:
            return 0.7
        for x, y in ((a, b), (b, a)):  # x a typo in a short form of y or in a name that y is short for
            if 3 <= len(x) <= 12 and x not in self.established and not _named(x) and any(edits(x, s, 1) <= 1 for s in (*_forms(y), *SHORT_FORMS.get(y, ())) if len(s) >= 3):
                return 0.65
        return 0.0

    def cover(self, a: Person, b: Person) -> float:
        """The least degree to which a field of a's name is found among b's names; 0 if a has no two words."""
        if len(a.units) < 2 and sum(map(len, a.units)) < 2:
            return 0.0
        worst = 1.0
        for field in a.units:
            worst = min(worst, self.found(field, b))
            if worst < 0.5:
                return 0.0
        return worst

    def found(self, field: list[str], b: Person) -> float:
        """The degree to which a field, as a whole or word by word, is found among b's names."""
        whole = field[0] if len(field) == 1 else "".join(field)
        if whole in b.joined:
            return 1.0
        alike, best = self.alike, 0.0
        for t in b.joined:
            s = alike(whole, t)
            if s > best:
                best = s
        if len(field) > 1:
            least = 1.0
            for w in field:
                most = 0.0
                for u in b.joined:
                    s = alike(w, u)
                    if s > most:
                        most = s
                least = min(least, most)
                if least <= best:
                    return best
            return least
        return best

    def middle(self, a: Person, b: Person) -> int:
        """1 if the middle names agree, 0 if one is missing, -1 if they differ; changed places with the first name count as agreeing."""
        if not a.middle or not b.middle:
            return 0
        if "".join(a.middle) == "".join(b.middle) or any(self.alike(x, y) >= 0.6 for x in a.middle for y in b.middle):
            return 1
        there = any(self.alike(x, y) >= 0.6 for x in a.middle for y in (*b.first, *b.last, *b.other))
        back = any(self.alike(x, y) >= 0.6 for x in b.middle for y in (*a.first, *a.last, *a.other))
        return 1 if there and back else -1

    def same_name(self, a: Person, b: Person) -> tuple[float, int]:
        """(how well the names agree, middle names as above)."""
        cover = self.cover(a, b)
        if cover < 1:
            cover = max(cover, self.cover(b, a))
        return cover, self.middle(a, b)

    def new_surname(self, a: Person, b: Person) -> bool:
        """First and middle name in full agreement: the last name may have changed."""
        whole = lambda x: len("".join(x)) >= 3
        first = max((self.alike(x, y) for x in a.first for y in b.first), default=0.0)
        middle = max((self.alike(x, y) for x in a.middle for y in b.middle if len(x) > 2 and len(y) > 2), default=0.0)
        return whole(a.first) and whole(b.first) and whole(a.middle) and whole(b.middle) and first >= 0.7 and middle >= 0.76

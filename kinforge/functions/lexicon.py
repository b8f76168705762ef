"""Words that the cleaning of names knows."""

# Suffixes in the order in which they are tried, with what they stand for.
SUFFIXES = {
    "IIII": "IV",
    "IV": "IV",
    "III": "III",
    " II": "II",
    " I": "I",
    ",I": "I",
    " 1": "I",
    ",1": "I",
    "2ND": "II",
    "3RD": "III",
    "4TH": "IV",
    "ESQ": "ESQ",
    "JR": "JR",
    "JR.": "JR",
    "SR": "SR",
    "2D": "II",
    "3D": "III",
    "2": "II",
    "3": "III",
    "4": "IV",
}
# Beginnings of last names that belong to the next word.
PREFIXES = frozenset("ABDEL ABDUL AB ABU AL CA C DA DE DEL DES DI DU D EL ET LOS JEAN TE VAN DELA DAL DER DELLA L LE LA MAC MC TEN TER VER VON O SAN SANTA".split())
# Beginnings of first names that belong to the next word.
FIRST_PREFIXES = frozenset("DA DE JA KE LA LE LU SA SAN TA TE TRE TY KA".split())
# Saints, titles.
SAINTS = frozenset("SAINT SAINTE ST STE".split())
TITLES = frozenset("MR MRS MS MISS DR".split())
# What stands for a missing name; a value counts only if it equals an entry, spaces included.
BAD_NAMES = frozenset(
    (
        "UNK,UNN,UNM,UKN,NKN,UJK,UKK,UUNKNOWN,UNKNOWED,UNKNW,UNKNOWH,UNNAMED,DUPLICAT,UNBORN,PERP,PERPETRAT,PERPRETRA,STEPDAD,STEPFATHE,STEPGRAND,MALECHILD,"
        "BIOCHILD,INKNOWN,BABY,BABYBOY,BABOYBOY,BABYGIRL,BABYSITTE,GIRL,BOYTWO,BOYFRIEND,BOY,BOYONE,GRANDFATH,GRANDMOTH,GRANDPA,GRANDMA,WOMAN,TWIN,TEEN,FEMALE,"
        "NUNKNOWN,MOM,THREE,ONE,CHILD,ABCUNKNOW,DAD,UNKNOWN,UNKNOWNAD,UNKNOWNBO,UNKNOWNGI,UNKNOWNMA,MISSING,VOID,ERROR,AKA,DCFS,MARRIED,DECD,SEE,ERR,NAME,PMD,"
        "PREV,FAMILY,N/A,MARRIEDNAME,DUPLICATE,UNKNOWNFEMALE,UNKNOWNCHILD,PERPETRATOR,MALE,UNKNOWNMALE,UNKNOWNADULT,DUNKNOWN,UNLKNOWN,UNLNOWN,UNOWNZ,ADULT,"
        "AUNKNOWN,BUNKNOWN,CUNKNOWN,EUNKNOWN,FUNKNOWN,GUNKNOWN,HUNKNOWN,IUNKNOWN,JUNKNOWN,UUNKNON,THE,UK,FIVE,UNNKNOWN,UNNKOWN,UNNOWN,ADULTSIBL,FATHER,"
        "GODFATHER,MOTHER,UKKNOWN,UKNKNOWN,UKNNOWN,UKNOWN,UKNOWNA,UKNOWNB,UKNOWNN,UNKA,UNKABC,UNKB,UNKC,UNKD,UNKE,UNKINOWN,UNKJNOWN,UNKKNOWN,UNKKOWN,UNKLNOWN,"
        "UNKMNOWN,UNKMOWN,UNKN,UNKNBOWN,UNKNIWN,UNKNIWON,UNKNKNOWN,UNKNKOWN,UNKNKOWNA,UNKNMOWN,UNKNNOWN,UNKNO,UNKNOAN,UNKNOEN,UNKNON,UNKNONN,UNKNONW,UNKNONWN,"
        "UNKNOON,UNKNOOWN,UNKNOQN,UNKNOSN,UNKNOW,UNKNOWA,UNKNOWB,UNKNOWC,UNKNOWING,UNKNOWM,UNKNOWNA,UNKNOWNAA,UNKNOWNAB,UNKNOWNAF,UNKNOWNAI,UNKNOWNAK,"
        "UNKNOWNAX,UNKNOWNB,UNKNOWNBB,UNKNOWNBF,UNKNOWNBL,UNKNOWNBR,UNKNOWNC,UNKNOWNCC,UNKNOWNCH,UNKNOWNCO,UNKNOWND,UNKNOWNDA,UNKNOWNDD,UNKNOWNE,UNKNOWNED,"
        "UNKNOWNEE,UNKNOWNEI,UNKNOWNF,UNKNOWNFA,UNKNOWNFE,UNKNOWNFF,UNKNOWNG,UNKNOWNGF,UNKNOWNGG,UNKNOWNGM,UNKNOWNGR,UNKNOWNH,UNKNOWNI,UNKNOWNIA,UNKNOWNJ,"
        "UNKNOWNJO,UNKNOWNK,UNKNOWNL,UNKNOWNM,UNKNOWNMG,UNKNOWNMK,UNKNOWNML,UNKNOWNMO,UNKNOWNMY,UNKNOWNN,UNKNOWNO,UNKNOWNP,UNKNOWNPA,UNKNOWNPE,UNKNOWNPG,"
        "UNKNOWNQ,UNKNOWNR,UNKNOWNS,UNKNOWNSI,UNKNOWNST,UNKNOWNT,UNKNOWNTE,UNKNOWNTH,UNKNOWNTW,UNKNOWNU,UNKNOWNUN,UNKNOWNV,UNKNOWNW,UNKNOWNWW,UNKNOWNX,"
        "UNKNOWNXY,UNKNOWNY,UNKNOWNZ,UNKNOWQN,UNKNOWSN,UNKNOWWN,UNKNWN,UNKNWO,UNKNWON,UNKNWONSI,UNKNWOWN,UNKNWWN,UNKONOWN,UNKONWN,UNKOWN,UNKOWNA,UNKOWNN,"
        "UNKTWO,UNMKNOWN,UNNOWKN,UNNOWNW,UNNOWWN,UNKNOWNAT,WHEREABOUTS,OOOOOOOOOO,XXXXXX,XXXXXXX,XXXXXXXX,XXXXXXXXX,XXXXXXXXXX,XXXXXXXXXXX,XXXXXXXXXXXX,"
        "XXXXXXXXXXXXX,XXXXXXXXXXXXXX,XXXXX,DULICATE,DUPILCATE,ANONYMOUS,JOHN DOE, JANE DOE,MARRIED NAME,NOT IN HOME,CLOSED ACCT,GROUP HOME,BUS COMPANY,"
        "BIG GUY,DUPLICATED,DUPLICTE,DUPLIC,DUPLICATE ID,NUMBER"
    ).split(",")
)

"""Word lists, thresholds and tables that results depend on."""

# ---- fixed values: quality thresholds -----------------------------------------
LEADING_FRAGMENT_LIMIT = 0.15
SEAM_FRAGMENT_LIMIT = 0.10
GIBBERISH_HARD_LIMIT = 0.40
GIBBERISH_SOFT_LIMIT = 0.25
NON_WORDLIKE_SOFT_LIMIT = 0.35
NON_WORDLIKE_HARD_LIMIT = 0.55
STABILITY_MINIMUM = 0.55
ENTROPY_LOW = 2.0
ENTROPY_HIGH = 5.5
UNCERTAINTY_HARD_LIMIT = 0.15
UNCERTAINTY_SOFT_LIMIT = 0.08
LEXICAL_MINIMUM = 0.20
MENTIONS_PER_1000_CHARS = 2
MENTIONS_AT_LEAST = 1
QUALITY_RANK = {"HIGH": 0, "OK": 1, "RISKY": 2, "UNRELIABLE": 3}

# ---- fixed values: linking tiers -----------------------------------------------
LINK_TIERS = {
    "HIGH": {"threshold": 0.80, "margin": 0.15, "similarity": 0.60},
    "MEDIUM": {"threshold": 0.85, "margin": 0.15, "similarity": 0.65},
    "LOW": {"threshold": 0.90, "margin": 0.20, "similarity": 0.70},
}

# ---- fixed values: letters ------------------------------------------------------
VOWELS = "aeiouyàâäéèêëïîôùûüœæ"
VOWELS_LATIN = "aeiouyàáâãäåæèéêëìíîïòóôõöùúûüýÿœ"
RARE_BIGRAMS = "zx xz qx xq jx xj zq qz bx xb vx xv kx xk wx xw jq qj jz zj bk kb fq qf vq qv zz xx qq".split()
UNLIKELY_BIGRAMS = "zx xz qx xq jx xj zq qz bx xb vx xv kx xk wx xw jq qj jz zj bk kb fq qf vq qv".split()
CONFUSION_REPLACEMENTS = (
    ("ſ", "s"), ("vn", "un"), ("ieh", "jeh"), ("œ", "oe"), ("æ", "ae"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
    ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ë", "e"), ("ï", "i"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'),
)
SCRIPT_RANGES = (
    ("latin", 0x0000, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x04FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0xFE70, 0xFEFF),
    ("hebrew", 0x0590, 0x05FF), ("cjk", 0x4E00, 0x9FFF), ("cjk", 0x3400, 0x4DBF), ("cjk", 0x3040, 0x309F), ("cjk", 0x30A0, 0x30FF), ("cjk", 0xAC00, 0xD7AF),
    ("devanagari", 0x0900, 0x097F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("armenian", 0x0530, 0x058F), ("ethiopic", 0x1200, 0x137F),
)

# ---- fixed values: word lists -----------------------------------------------------
COMMON_WORDS = sorted(set((
    "a au aux car ce ces comme dans de des du en est et il ils je la le les leur lui mais me mes mon ne ni nos nous on ou par pas plus pour que qui "
    "sa se ses si son sur te tes ton tu un une vous al com con del d el li lo lor molt moult ot ont uns vont ala alerent aussi avoit bien dit dist "
    "donc dont estoit fait firent fist font fut lors puis sont tant tout vint main port ente pont tour mont fort camp part mort sort vent voie aide "
    "arme cent droit lieu mise note page rien sens site terre temps voir vers cors char cuer cour dame dieu ante post inter super amen voin elain ament"
).split()))
FUNCTION_WORDS = sorted(set((
    "a à au de du en et il je la le li ne ni nu on ou où si tu un ab ad an at ex in is it id ob se ut al da di do el eu ha ho lo mi no os su te ti va vi yo "
    "am as be by go he if me my of ok or so to up us we um zu e i o u y"
).split()))
CHUNK_STOPWORDS = "a e i o u y et de la le en il ne si ce".split()
PLACE_ANCHORS = "lausanne paris lyon rome avignon geneve genève".split()
TITLE_ANCHORS = "euesque évesque evesque prince chapellain pere".split()
DATE_ANCHORS = ["an", "l'an", "l’an", "lan", "ans", "apres", "après", "avant"]
MONTHS = (
    "janvier fevrier février mars avril mai juin juillet août aout septembre octobre novembre decembre décembre "
    "januarii februarii martii aprilis maii junii julii augusti septembris octobris novembris decembris"
).split()
TRIGRAMS = {
    "latin": (
        "ent ter ion tio ati nis est unt tis que per tur ita oru rum ere iss sti con ant mus qui ius ine eri min men ali tes pro tra str bus ris dem cum nos dom ndo tus ium omi "
        "ect tat atu sec nes ver tan pot ens mit pra end ost pon aut quo tem und int rat cit dit ibu tri non nti nte sed ras ica rea ore mis mni lla pri lib nim uri eni san ern ist acc "
        "pre nat cre gen gra mul ple sem spi"
    ).split(),
    "french": (
        "les ent des que ion est ait ons ant ous our con par com eur ois ure ier ter res nce ble men ais oir ort pre pro age ell omm app lle iss ans tre ain ein oin enc emp ens che cha "
        "ran san man dis mis fai mai rai tai nte ntr str iqu eme ess ass iti ali eau aux eux ieu oeu ail eil ouv chi cho chu gne"
    ).split(),
    "old_french": (
        "ent les est ant oit ois que ous ure des ont aut par ain ien ter our ort com con ere ier ion ais ame oie roi ors ver ali nes mes lor art ard ust ren out tot poi hom gra ran ble res nce ele "
        "rou uss eur der sen ten gen ave oir vil ail ner rei erm sem pre pro soi ign age onn rie anc ari noi moi doi voi nui tos uel cor don mon hon bon fon pon lon son enc emp ens erl ein oin uin"
    ).split(),
    "middle_french": (
        "ent les est que ant des ous our ion con par ois com ait ure ont ter aut ain ien ere res ier nce ble eur ais ort ren mes ver ali art ard pre pro sen ten gen age onn rie ave "
        "enc emp ens erl ein oin uin oir deu ieu roy mon don hon bon pon tre ell omm app aue lle iss ans pri che cha chi cho chu ran san man dis mis fai mai lai pai rai sai tai "
        "ign gne ner mer per der ser ler rer nte ntr str cti iqu eme ess ass oss"
    ).split(),
}
TRIGRAM_ALIASES = {"anglo_norman": "old_french", "occitan": "middle_french", "italian": "latin", "spanish": "latin", "portuguese": "latin", "catalan": "middle_french"}

# ---- fixed values: authority types --------------------------------------------------
TYPE_QIDS = {
    "person": "Q5 Q15632617 Q95074 Q3658341 Q15773317 Q15773347 Q4271324 Q21070568 Q14073567".split(),
    "place": "Q515 Q486972 Q6256 Q35657 Q3024240 Q82794 Q23442 Q46831 Q8502 Q4022 Q618123 Q2221906 Q1549591 Q3957 Q532".split(),
    "org": "Q43229 Q4830453 Q3918 Q9174 Q1530022".split(),
    "work": "Q7725634 Q571 Q47461344 Q11424 Q5398426".split(),
    "title": "Q7725634 Q571 Q47461344".split(),
    "event": "Q1190554 Q178561 Q198".split(),
}
NAME_QIDS = "Q202444 Q101352 Q12308941 Q11879590 Q4167410 Q66480858".split()

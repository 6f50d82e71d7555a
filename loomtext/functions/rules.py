"""Rule data: fixed values that normalising, splitting and pronouncing depend on."""

#: Literals that are read out as words.
EXPANSIONS = [
    ("i.e.", "that is"), ("e.g.", "for example"), ("vs.", "versus"), ("etc.", "et cetera"), ("et al.", "and others"),
    ("cf.", "compare"), ("approx.", "approximately"), ("N.B.", "note well"), ("w/o", "without"), ("w/", "with"),
    ("b/c", "because"), ("n/a", "not applicable"), (">=", "greater than or equal to"), ("<=", "less than or equal to"),
    ("->", "to"), ("=>", "to"),
]

#: Symbols, what they are read as, and where.
SYMBOLS = [
    ("&", "and", "isolated"), ("@", "at", "isolated"), ("+", "plus", "isolated"), ("=", "equals", "isolated"),
    ("%", "percent", "digit-before"), ("#", "number", "digit-after"), ("~", "about", "digit-after"), ("§", "section", "digit-after"),
    ("°", "degrees", "digit-before"), ("©", "copyright", "always"), ("™", "trademark", "always"), ("®", "registered", "always"),
]

#: Currency signs with their singular and plural.
CURRENCY = [("$", "dollar", "dollars"), ("£", "pound", "pounds"), ("€", "euro", "euros"), ("¥", "yen", "yen")]

#: Abbreviations by category; only titles and military never end a sentence in the "offsets" dialect.
ABBREVIATIONS = {
    "titles": "Mr Mrs Ms Dr Prof Rev Hon St Sr Jr Fr Msgr Gov Sen Rep Pres Supt Det Insp".split(),
    "military": "Gen Col Lt Cmdr Capt Maj Sgt Cpl Pvt Adm Brig".split(),
    "academic": ["Ph.D", "M.D", "B.A", "M.A", "D.D.S", "Ed.D", "LL.B", "LL.M", "M.B.A", "et al", "cf", "ibid", "op. cit", "viz", "vs", "etc", "e.g", "i.e", "n.b", "B.Sc", "M.Sc", "B.S", "M.S", "ref"],
    "business": "Inc Ltd Co Corp LLC PLC GmbH Bros dept est approx min max avg std incl excl".split(),
    "geographic": "U.S U.S.A U.K E.U Ave Blvd Rd Ln Ct Dr Mt Ft Pt Is".split(),
    "months": "Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec".split(),
    "days": "Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun".split(),
    "units": "in ft yd mi oz lb pt qt gal sec hr wk yr no vol pp fig ch".split(),
    "time": "a.m p.m A.M P.M".split(),
}

#: How a fenced block's language is said.
LANGUAGE_NAMES = {
    "powershell": "PowerShell", "ps1": "PowerShell", "pwsh": "PowerShell", "sh": "Shell", "bash": "Shell", "zsh": "Shell",
    "shell": "Shell", "cmd": "Command prompt", "bat": "Batch", "py": "Python", "python": "Python", "js": "JavaScript",
    "javascript": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript", "tsx": "TypeScript",
    "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "html": "HTML", "css": "CSS", "sql": "SQL", "xml": "XML",
    "md": "Markdown", "c": "C", "cpp": "C plus plus", "cs": "C sharp", "java": "Java", "go": "Go", "rs": "Rust", "rust": "Rust",
    "rb": "Ruby", "php": "PHP", "diff": "Diff", "patch": "Patch", "text": "Plain text", "txt": "Plain text",
}

#: Sounds of the pronunciation alphabet, and those that are long unless unstressed.
ARPA = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "B": "b", "CH": "ʧ", "D": "d", "DH": "ð", "EH": "ɛ",
    "ER": "ɚ", "EY": "eɪ", "F": "f", "G": "ɡ", "HH": "h", "IH": "ɪ", "IY": "i", "JH": "ʤ", "K": "k", "L": "l", "M": "m",
    "N": "n", "NG": "ŋ", "OW": "oʊ", "OY": "ɔɪ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ", "T": "t", "TH": "θ", "UH": "ʊ",
    "UW": "u", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
LENGTHENED = {"AA": "ɑː", "AO": "ɔː", "IY": "iː", "UW": "uː"}

#: Spellings and their sounds, the first that fits wins.
SPELLINGS = [
    ("tion", "ʃən"), ("sion", "ʒən"), ("ough", "ʌf"), ("augh", "æf"), ("tch", "ʧ"), ("dge", "ʤ"), ("igh", "aɪ"), ("ing", "ɪŋ"),
    ("ch", "ʧ"), ("sh", "ʃ"), ("th", "θ"), ("ph", "f"), ("wh", "w"), ("ck", "k"), ("qu", "kw"), ("ng", "ŋ"), ("gh", "ɡ"),
    ("ee", "iː"), ("ea", "iː"), ("oo", "uː"), ("ou", "aʊ"), ("ow", "aʊ"), ("ai", "eɪ"), ("ay", "eɪ"), ("oi", "ɔɪ"), ("oy", "ɔɪ"),
    ("au", "ɔː"), ("a", "æ"), ("e", "ɛ"), ("i", "ɪ"), ("o", "ɑ"), ("u", "ʌ"), ("y", "i"), ("b", "b"), ("c", "k"), ("d", "d"),
    ("f", "f"), ("g", "ɡ"), ("h", "h"), ("j", "ʤ"), ("k", "k"), ("l", "l"), ("m", "m"), ("n", "n"), ("p", "p"), ("r", "ɹ"),
    ("s", "s"), ("t", "t"), ("v", "v"), ("w", "w"), ("x", "ks"), ("z", "z"),
]

#: Letters that decomposition leaves alone.
FOLDED = {"ł": "l", "ø": "o", "đ": "d", "ð": "th", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"}

#: Words that tell which reading of the next word is meant.
DETERMINERS = "the a an this that these those his her its their my your our no any some each every another one two three more most such".split()
VERB_CUES = "to will would can could shall should may might must i we you they he she it who and or not don't please help let".split()
PAST_CUES = "have has had having already yesterday once never just".split()
#: Words with two readings: (after a determiner, after a verb cue); "read" has (past, present), "live" its second by default.
READINGS = {
    "read": ("R EH1 D", "R IY1 D"), "lead": ("L EH1 D", "L IY1 D"), "live": ("L AY1 V", "L IH1 V"), "wind": ("W IH1 N D", "W AY1 N D"),
    "close": ("K L OW1 S", "K L OW1 Z"), "use": ("Y UW1 S", "Y UW1 Z"), "minute": ("M IH1 N AH0 T", None), "tear": ("T IH1 R", "T EH1 R"),
    "bow": ("B OW1", "B AW1"),
}

#: Two-letter sounds of the pronunciation alphabet that the voice's alphabet has as one.
LIGATURES = [("dʒ", "ʤ"), ("tʃ", "ʧ"), ("ts", "ʦ"), ("dz", "ʣ"), ("tɕ", "ʨ"), ("dʑ", "ʥ")]


def abbreviations() -> list[str]:
    """All abbreviations in lower case without the full stops at their ends."""
    return sorted({a.lower().strip(".") for words in ABBREVIATIONS.values() for a in words})

"""Sounds of the English and irregular words of station, line and train type names. (fixed values)"""

WORDS = {
    "airport": "ɛɚpɔɹt", "and": "ænd", "art": "ɑɹt", "avenue": "ævənuː", "atomic": "ətɑmɪk", "beach": "biːtʃ", "beer": "bɪɹ",
    "big": "bɪg", "blue": "bluː", "branch": "bɹæntʃ", "bomb": "bɑm", "botanical": "bətænɪkəl", "building": "bɪldɪŋ",
    "business": "bɪznəs", "bus": "bʌs", "cable": "keɪbəl", "campus": "kæmpəs", "castle": "kæsəl", "center": "sɛntɚ",
    "centre": "sɛntɚ", "central": "sɛntɹəl", "city": "sɪti", "commuter": "kəmjuːtɚ", "conference": "kɑnfɚəns", "cruise": "kɹuːz",
    "cross": "kɹɔs", "district": "dɪstɹɪkt", "distribution": "dɪstɹəbjuːʃən", "direct": "dɚɛkt", "east": "iːst",
    "electric": "ɪlɛktɹɪk", "elementary": "ɛləməntɛɹi", "entrance": "ɛntɹəns", "evening": "iːvnɪŋ", "express": "ɪkspɹɛs",
    "family": "fæməli", "ferry": "fɛɹi", "flower": "flaʊɚ", "for": "fɔɹ", "from": "fɹʌm", "fruit": "fɹuːt", "garden": "gɑɹdən",
    "gardens": "gɑɹdənz", "gateway": "geɪtweɪ", "general": "dʒɛnɚəl", "golf": "gɑlf", "green": "gɹiːn", "ground": "gɹaʊnd",
    "gymnasium": "dʒɪmneɪziəm", "hall": "hɔl", "high": "haɪ", "hospital": "hɑspɪtəl", "industrial": "ɪndʌstɹiəl",
    "international": "ɪntɚnæʃənəl", "island": "aɪlənd", "isle": "aɪl", "japan": "dʒəpæn", "jr": "dʒeɪ ɑɹ", "junior": "dʒuːnjɚ",
    "keisei": "keːseː", "line": "laɪn", "link": "lɪŋk", "liner": "laɪnɚ", "lrt": "ɛl ɑɹ tiː", "limited": "lɪmɪtɪd",
    "local": "loʊkəl", "loop": "luːp", "main": "meɪn", "mae": "mae", "management": "mænɪdʒmənt", "marine": "məɹiːn",
    "medical": "mɛdɪkəl", "metro": "mɛtɹoʊ", "monorail": "mɑnoʊɹeɪl", "morning": "mɔɹnɪŋ", "museum": "mjuːziəm",
    "municipal": "mjuːnɪsəpəl", "new": "nuː", "north": "nɔɹθ", "or": "ɔɹ", "park": "pɑɹk", "peace": "piːs", "port": "pɔɹt",
    "pool": "puːl", "railway": "ɹeɪlweɪ", "rail": "ɹeɪl", "rapid": "ɹæpɪd", "red": "ɹɛd", "regional": "ɹiːdʒənəl",
    "relay": "ɹiːleɪ", "ropeway": "ɹoʊpweɪ", "route": "ɹuːt", "scenic": "siːnɪk", "saint": "seɪnt", "school": "skuːl",
    "science": "saɪəns", "section": "sɛkʃən", "seaside": "siːsaɪd", "semi": "sɛmi", "senior": "siːnjɚ", "shiyakusho": "ɕijakɯɕo",
    "sight": "saɪt", "site": "saɪt", "skiing": "skiːɪŋ", "skytree": "skaɪtɹiː", "soccer": "sɑkɚ", "south": "saʊθ",
    "space": "speɪs", "special": "spɛʃəl", "sports": "spɔɹts", "square": "skwɛɚ", "stadium": "steɪdiəm", "station": "steɪʃən",
    "streetcar": "stɹiːtkɑɹ", "subway": "sʌbweɪ", "service": "sɝvɪs", "shuttle": "ʃʌtəl", "sub": "sʌb", "sunrise": "sʌnɹaɪz",
    "super": "suːpɚ", "telecom": "tɛləkɑm", "teleport": "tɛləpɔɹt", "terminal": "tɚmɪnəl", "the": "ðə", "town": "taʊn",
    "to": "tuː", "trade": "tɹeɪd", "train": "tɹeɪn", "transit": "tɹænsɪt", "tramway": "tɹæmweɪ", "tram": "tɹæm",
    "transport": "tɹænspɔɹt", "university": "juːnəvɚsəti", "universal": "juːnəvɚsəl", "urban": "ɝbən", "village": "vɪlɪdʒ",
    "way": "weɪ", "west": "wɛst", "world": "wɝld", "yard": "jɑɹd", "railroad": "ɹeɪlɹoʊd", "access": "æksɛs",
    "excursion": "ɪkskɝʒən", "holiday": "hɑlədeɪ", "nonstop": "nɑnstɑp", "weekday": "wiːkdeɪ", "southern": "sʌðɚn", "sky": "skaɪ",
    "office": "ɔfɪs", "police": "pəliːs", "shrine": "ʃɹaɪn", "temple": "tɛmpəl", "prefectural": "pɹifɛktʃɚəl", "bridge": "bɹɪdʒ",
    "plaza": "plɑːzə", "canal": "kənæl", "hotel": "hoʊtɛl", "cathedral": "kəθiːdɹəl", "arts": "ɑɹts", "crafts": "kɹæfts",
    "theater": "θiətɚ", "abt": "eɪ biː tiː", "angelland": "eɪndʒəllænd", "arcade": "ɑɹkeɪd", "anoh": "ano", "astram": "æstɹæm",
    "balloon": "bəluːn", "boat": "boʊt", "bitchu": "bit͡ɕɯ", "bitchuu": "bit͡ɕɯː", "bosch": "bɑʃ", "car": "kɑɹ",
    "centerpool": "sɛntɚpuːl", "centralpark": "sɛntɹəlpɑɹk", "chinatown": "tʃaɪnətaʊn", "chikucenter": "tʃikjuːsɛntɚ",
    "civic": "sɪvɪk", "circuit": "sɝkɪt", "cosmosquare": "kɑzmoʊskwɛɚ", "dam": "dæm", "depot": "diːpoʊ", "dinostar": "daɪnoʊstɑɹ",
    "english": "ɪŋglɪʃ", "etchu": "ett͡ɕɯ", "etchuu": "ett͡ɕɯː", "esta": "ɛstə", "expo": "ɛkspoʊ", "galaxy": "gæləksi",
    "gorge": "gɔɹdʒ", "hatchobaba": "hatt͡ɕoːbaba", "hatchobori": "hatt͡ɕoːboɾi", "huis": "haʊs", "itchome": "itt͡ɕoːme",
    "ir": "aɪ ɑɹ", "j": "dʒeɪ", "juhatchome": "dʑɯːhatt͡ɕoːme", "kintestu": "kintetsɯ", "kutchan": "kɯtt͡ɕaɴ", "linimo": "linimo",
    "minoh": "minoː", "newtown": "njuːtaʊn", "no.1": "nʌmbɚ wʌn", "no.6": "nʌmbɚ sɪks", "no.7": "nʌmbɚ sɛvən",
    "no.8": "nʌmbɚ eɪt", "peach": "piːtʃ", "retro": "ɹɛtɹoʊ", "rias": "ɹiːəs", "shim": "ɕiɴ", "side": "saɪd",
    "skyliner": "skaɪlaɪnɚ", "skyrail": "skaɪɹeɪl", "sonic": "sɑnɪk", "saphir": "sæfiɹ", "spacia": "speɪʃə", "sta": "steɪʃən",
    "sunport": "sʌnpɔɹt", "th": "tiː eɪtʃ", "through": "θɹuː", "thunderbird": "θʌndɚbɝd", "tj": "tiː dʒeɪ", "wing": "wɪŋ",
    "woody": "wʊdi", "x": "ɛks", "aqua": "ækwə", "lavender": "lævəndɚ", "lilac": "laɪlæk", "okhotsk": "oʊkhɑtsk", "b": "biː",
    "crossbay": "kɹɔsbeɪ", "farm": "fɑɹm", "field": "fiːld", "gala": "gɑːlə", "girls": "gɝlz", "grand": "gɹænd",
    "highland": "haɪlənd", "hills": "hɪlz", "harmonyhall": "hɑɹmənihɔl", "harborland": "hɑɹbɚlænd", "heartpia": "hɑɹtpiə",
    "land": "lænd", "laketown": "leɪktaʊn", "mall": "mɔl", "mary's": "mɛɹiz", "mt": "maʊnt", "mt.takao": "maʊnt taka.o",
    "mt.fuji": "maʊnt ɸɯdʑi", "norfolk": "nɔɹfoʊk", "ohmi": "oːmi", "oarks": "oʊks", "paddy": "pædi", "pref": "pɹɛf",
    "costa": "kɔstə", "grandberry": "gɹændbɛɹi", "fujifilm": "ɸɯdʑifɪɾɯm", "fujitec": "ɸɯdʑitek", "intec": "ɪntek",
    "jatco": "dʒætkoʊ", "s": "ɛs", "t": "tiː", "trans": "tɹæns", "zoological": "zuːəlɑdʒɪkəl", "bayside": "beɪsaɪd",
    "disney": "dɪzni", "disneyland": "dɪznilænd", "sea": "siː", "girls'": "gɝlz", "gran": "gɹɑːn", "playpia": "pleɪpiə",
    "portopia": "pɔɹtoʊpiə", "pref.art": "pɹɛf ɑɹt", "pref.sports": "pɹɛf spɔɹts", "race": "ɹeɪs", "resort": "ɹɪzɔɹt",
    "river": "ɹɪvɚ", "royce'": "ɹɔɪs", "ruins": "ɹuːɪnz", "screen": "skɹiːn", "shop": "ʃɑp", "socio": "soʊʃioʊ", "we": "wɛ",
    "spa": "spɑː", "st": "seɪnt", "tennis": "tɛnɪs", "toyopet": "toʊjoʊpɛt", "univ": "juːnəvɚsəti", "vogel": "foʊgəl",
    "yomiuriland": "jomiɯɾilænd", "yrp": "waɪ ɑɹ piː", "3choume": "sant͡ɕoːme", "4choume": "jont͡ɕoːme", "daiunzi": "daiɯɲdʑi",
    "etchuujima": "ett͡ɕɯːdʑima", "golfjomae": "gɑlf dʑoːmae", "hasirano": "haɕiɾano", "hatcho": "hatt͡ɕoː",
    "hatchome": "hatt͡ɕoːme", "hatchonawate": "hatt͡ɕoːnawate", "hatchoubori": "hatt͡ɕoːboɾi", "hatcomuta": "hatt͡ɕoːmɯta",
    "inadazutumi": "inadadzɯt͡sɯmi", "inuboh": "inɯboː", "itchumae": "itt͡ɕɯːmae", "itihana": "it͡ɕihana",
    "juitchome": "dʑɯːitt͡ɕoːme", "kohjiro": "koːdʑiɾo", "kozyou": "kodʑoː", "mitumatu": "mit͡sɯmat͡sɯ", "mitusawa": "mit͡sɯsawa",
    "nijuhatchome": "ɲidʑɯːhatt͡ɕoːme", "oh": "oː", "ohda": "oːda", "ohmisaki": "oːmisakʲi", "ohshou": "oːɕoː",
    "saidaizi": "saidaidʑi", "saigoh": "saigoː", "shicikenjaya": "ɕit͡ɕikeɲdʑaja", "sirokanedai": "ɕiɾokanedai",
    "sizuoka": "ɕizɯoka", "suzi": "sɯdʑi", "tamati": "tamat͡ɕi", "tsudumigaura": "t͡sɯdzɯmigaɯɾa",
}

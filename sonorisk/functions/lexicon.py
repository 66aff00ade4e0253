"""Word lists, patterns and weights of the text rules.

Fixed values: every table here is part of the result contract and is stated as plain text.
"""

# -- fixed values: intent labels, weights and rule patterns (first match per label wins) --
INTENT_WEIGHT = {
    "manufactured_urgency": 0.35,
    "secrecy_demand": 0.55,
    "authority_pressure": 0.35,
    "unusual_channel": 0.3,
    "callback_resistance": 0.5,
    "unusual_beneficiary": 0.45,
    "credential_request": 0.6,
    "payment_request": 0.3,
}
INTENT_PATTERNS = {
    "manufactured_urgency": [
        r"\b(right now|immediately|urgent(ly)?|as soon as possible|asap|within (the next )?\d+ (minutes|mins|hours)|before (the )?(end of (the )?day|market closes?|\d))\b",
        r"\b(jaldi|turant|abhi ke abhi|foran|fauran)\b",
        r"(तुरंत|जल्दी|अभी के अभी|फौरन)",
        r"\b(account will be (blocked|frozen|suspended)|last chance|deal will fall through)\b",
    ],
    "secrecy_demand": [
        r"\b(don'?t|do not|never) (tell|inform|mention|discuss|share)( this)? (with |to )?(anyone|anybody|the team|your (manager|colleagues|family|bank))\b",
        r"\b(keep (this|it) (confidential|secret|between us|quiet))\b",
        r"\b(kisi ko (bhi )?(mat|na) (batana|bataiye|bolna|batao))\b",
        r"(किसी को (भी )?(मत|ना) (बताना|बताइए|बोलना))",
    ],
    "authority_pressure": [
        r"\b(this is|it'?s|i'?m|i am) (the |your )?(ceo|cfo|coo|md|managing director|director|chairman)\b",
        r"\bmain (ceo|cfo|coo|md|managing director|director|chairman) (bol raha|bol rahi|baat kar raha)",
        r"\b(rbi|reserve bank|income tax (department|officer)|cbi|police|cyber cell|customs|enforcement directorate)\b",
        r"\b(on (my|the (board'?s|ceo'?s)) (authority|instructions|orders)|i'?m ordering you)\b",
        r"(आरबीआई|पुलिस|सीबीआई|इनकम टैक्स)",
    ],
    "unusual_channel": [
        r"\b(whatsapp|telegram|signal|personal (number|phone|email)|gmail|my other number)\b",
        r"\b(anydesk|teamviewer|quick ?support|screen ?shar(e|ing))\b",
    ],
    "callback_resistance": [
        r"\b(don'?t|do not|no need to) (call|ring) (me )?back\b",
        r"\b(i can'?t|cannot|won'?t be able to) (take|receive) (a |your )?call(s)?\b",
        r"\b(no time (to|for) (verify|verification|call ?back))\b",
        r"\b(call ?back mat (karo|kijiye|karna))\b",
    ],
    "unusual_beneficiary": [
        r"\b(new (vendor|beneficiary|supplier|account)|different account|updated (bank|account) details)\b",
        r"\b(transfer (it )?to (this|a new|another) account)\b",
        r"\b(naya (account|khata))\b",
        r"(नया (खाता|अकाउंट))",
    ],
    "credential_request": [
        r"\b(tell|give|share|read( out)?|send) (me )?(the |your )?(\[OTP\]|otp|pin|cvv|password|passcode|verification code)\b",
        r"\b(otp|pin|cvv) (batao|bataiye|bhejo|dijiye|share karo)\b",
        r"(ओटीपी|पिन) (बताइए|बताओ|भेजो)",
        r"\[OTP\]",
    ],
    "payment_request": [
        r"\b(wire|transfer|send|remit|pay) (the )?(money|funds|amount|payment|\d[\d,]*|rs\.?|inr|₹|lakh|crore)",
        r"\b(paise|paisa|rupaye|amount) (bhejo|bhej do|transfer karo|daal do)\b",
        r"\b\d[\d.,]*\s*(lakh|crore|rupees|rs|inr)\b.{0,40}\b(transfer|bhej|send|pay|wire)",
        r"(पैसे|रुपये) (भेजो|भेज दो|ट्रांसफर)",
        r"\b(gift cards?|crypto|bitcoin|usdt)\b",
    ],
}
INTENT_RULE_CONFIDENCE = 0.8

# -- fixed values: personal-data patterns in precedence order; (kind, pattern, ignore case, group) --
PII_PATTERNS = [
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", False, 0),
    ("upi_id", r"\b[\w.-]{2,}@(?:ok\w+|ybl|paytm|upi|apl|ibl|axl|icici|sbi|hdfcbank)\b", True, 0),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", False, 0),
    ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", False, 0),
    ("otp", r"(?:otp|o\.t\.p|pin|cvv|cvc|passcode|password|code|ओटीपी|पिन|कोड)[^\d\n]{0,20}(\d[\d\s-]{2,9}\d)", True, 1),
    ("card_number", r"\b(?:\d[ -]?){13,19}\b", False, 0),
    ("aadhaar", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b", False, 0),
    ("phone", r"(?:\+91[\s-]?)?\b[6-9]\d{4}[\s-]?\d{5}\b", False, 0),
    ("account_number", r"\b\d{9,18}\b", False, 0),
]

# -- fixed values: number words (English, romanised and Devanagari Hindi) --
NUMBER_WORDS = (
    "zero oh one two three four five six seven eight nine double triple "
    "shunya ek do teen char chaar paanch panch chhe che saat aath nau "
    "शून्य एक दो तीन चार पांच पाँच छह सात आठ नौ"
).split()

# -- fixed values: script blocks, markers and the romanised-Hindi lexicon --
SCRIPT_BLOCKS = [
    ("ऀ", "ॿ", "hi"),
    ("ঀ", "৿", "bn"),
    ("਀", "੿", "pa"),
    ("઀", "૿", "gu"),
    ("଀", "୿", "or"),
    ("஀", "௿", "ta"),
    ("ఀ", "౿", "te"),
    ("ಀ", "೿", "kn"),
    ("ഀ", "ൿ", "ml"),
    ("؀", "ۿ", "ur"),
]
MARATHI_MARKERS = "आहे नाही आणि मला तुम्ही काय आहेत झाले".split()
ASSAMESE_CHARS = "ৰৱ"
HINGLISH = (
    "hai hain nahi nahin kya kyun aap aapka aapko mera meri mujhe hum haan ji jaldi abhi paisa paise bhejo bhej karo kar "
    "kijiye dijiye bataiye batao matlab yaar accha acha theek thik bolo boliye sir madam kisi ko mat bataana batana turant "
    "bank khata rupaye lakh crore wala wali se ka ki ke aur lekin toh bhi hoga hogi raha rahi rahe ho jayega jayegi jaayega "
    "hoon hun main mein tum tumhara apna apni karna karni kariye liye kuch sab yeh woh vo ye par pe tak gaya gayi diya liya "
    "dena lena chahiye sakte sakta sakti kaise kab kahan"
).split()

# -- fixed values: fillers per language and the ones every language shares --
FILLERS = {
    "en": ["um", "umm", "uh", "uhh", "er", "erm", "ah", "hmm", "mm", "like", "you know", "i mean"],
    "hi": ["अं", "अम्म", "हम्म", "मतलब", "वो", "यानी", "तो", "हाँ", "matlab", "yaani", "woh", "haan", "hmm", "um"],
    "ta": ["அது", "வந்து", "அப்புறம்", "ம்ம்", "vandhu", "adhu", "appuram", "hmm"],
    "te": ["అంటే", "అది", "ఏంటంటే", "ante", "adi", "hmm"],
    "bn": ["মানে", "ইয়ে", "mane", "iye", "hmm"],
    "mr": ["म्हणजे", "ते", "mhanje", "hmm"],
}
GENERIC_FILLERS = ["um", "umm", "uh", "uhh", "hmm", "mm", "er", "ah"]

# -- fixed values: languages with the longer minimum pause --
INDIC = "hi bn ta te mr gu kn ml pa or as ur sa".split()

"""Fixed values of the data model."""

# Code points and the ASCII character that stands in for each; every pair keeps the length.
ASCII_FOR = {
    "«": "\"", "\u00ad": "-", "´": "'", "»": "\"", "÷": "/", "ǀ": "|", "ǃ": "!", "ʹ": "'", "ʺ": "\"", "ʼ": "'", "˄": "^", "ˆ": "^", "ˈ": "'",
    "ˋ": "`", "ˍ": "_", "˜": "~", "\u0300": "`", "\u0301": "'", "\u0302": "^", "\u0303": "~", "\u030b": "\"", "\u030e": "\"", "\u0331": "_",
    "\u0332": "_", "\u0338": "/", "։": ":", "׀": "|", "׃": ":", "٪": "%", "٭": "*", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-",
    "‖": "|", "‗": "_", "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": "\"", "”": "\"", "„": "\"", "‟": "\"", "′": "'", "″": "\"", "‴": "'", "‵": "`",
    "‶": "\"", "‷": "'", "‸": "^", "‹": "<", "›": ">", "‽": "?", "⁄": "/", "⁎": "*", "⁒": "%", "⁓": "~", "\u20e5": "\\", "−": "-", "∕": "/",
    "∖": "\\", "∗": "*", "∣": "|", "∶": ":", "∼": "~", "≤": "<", "≥": ">", "≦": "<", "≧": ">", "⌃": "^", "〈": "<", "〉": ">", "♯": "#", "✱": "*",
    "❘": "|", "❢": "!", "⟦": "[", "⟨": "<", "⟩": ">", "⦃": "{", "⦄": "}", "〃": "\"", "〈": "<", "〉": ">", "〛": "]", "〜": "~", "〝": "\"", "〞": "\"",
    "\u200b": " ", "\u2060": " ", "\ufeff": " ",
}
ASCII_FROM, ASCII_TO = "".join(ASCII_FOR), "".join(ASCII_FOR.values())

# The states of the USA by their abbreviations.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}

# What the types of a link speak for, places before bodies before people.
LINK_TYPES = {"LOCATION": "location|place|city|country|state|province", "ORGANIZATION": "business|corporation|company|organization", "PERSON": "people|person"}

# Pronouns taken for people; those that are missing here attach to things only.
PERSONAL = ["he", "his", "her", "hers", "me", "mine", "we", "our", "us", "i", "you"]
PRONOUNS = [*PERSONAL, "she", "him", "they", "them", "it", "its", "their", "theirs", "my", "your", "yours", "ours", "this", "that", "these", "those", "who", "whom"]

# Bounds of a usable sentence, and the least score of a link.
MOST_CHARS, LEAST_GAPS, LEAST_SCORE = 750, 3, 5.0

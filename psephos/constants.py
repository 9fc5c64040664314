"""Fixed values.

Everything below must equal the values the original election reports use;
they are data, not logic. Keep them together, in natural order, as text.
"""

# --- fixed values: election-report constants -------------------------------

# Parties grouped as the Coalition.
COALITION_PARTIES = ["LP", "LNP", "NP", "CLP"]

# Label for the grouped Coalition parties in funding and comparison reports.
COALITION_LABEL = "COAL"

# Public funding rate per first-preference vote, in cents.
FUNDING_CENTS_PER_VOTE = 262.784

# Share of the formal vote a party must pass (strictly) to be funded, percent.
FUNDING_THRESHOLD_PERCENT = 4.0

# National enrolment used as the pre-poll divisor.
NATIONAL_ENROLMENT = {"2013": 14712799, "2016": 15676659}

# Territories whose Senate quota divisor is fixed at 3 (2 vacancies).
TERRITORIES = ["ACT", "NT"]

# Dummy polling places that carry declaration votes, keyed by vote column.
DUMMY_PLACES = {
    "AbsentVotes": "_dummy_absent",
    "ProvisionalVotes": "_dummy_provisional",
    "PrePollVotes": "_dummy_prepolldec",
    "PostalVotes": "_dummy_postal",
}

# Polling-place names matching this (case-sensitive) pattern are pre-poll
# voting centres whose votes count as ordinary votes.
PREPOLL_PLACE_PATTERN = "PPVC|PREPOLL"

# Marker of the informal (invalid) ballot row, used in PartyNm and Surname.
INFORMAL = "Informal"

# Division renames applied to 2013 pre-poll data (old name -> new name).
DIVISION_RENAMES_2013 = {"Fraser": "Fenner", "Throsby": "Whitlam"}

# Prefix of the day columns in the wide pre-poll files (Day01, Day02, ...).
DAY_FORMAT = "Day%02d"

# Number of day columns in each pre-poll file.
PREPOLL_DAYS = 16

# Preamble lines before the header row in the result feeds.
FEED_PREAMBLE_LINES = 1
ENROLMENT_2016_PREAMBLE_LINES = 4

# Timestamp pattern of the seat-summary CSV name: HoR-<stamp>.csv
SEAT_SUMMARY_NAME = "HoR-{stamp}.csv"
SEAT_SUMMARY_STAMP = "%Y%m%d-%H%M"

# --- vote-type columns, in feed order ----------------------------------------

VOTE_TYPES = ["OrdinaryVotes", "AbsentVotes", "ProvisionalVotes", "PrePollVotes", "PostalVotes"]
VOTE_COLUMNS = VOTE_TYPES + ["TotalVotes"]

# The seven TCP vote columns once pre-poll ordinary votes are added.
TCP_TYPES = [
    "OrdinaryVotes",
    "PrepollOrdinary",
    "AbsentVotes",
    "ProvisionalVotes",
    "PrePollVotes",
    "PostalVotes",
    "TotalVotes",
]

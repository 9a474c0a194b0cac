"""Tables that the operators take and give, as DDL. Every table carries ``song_id``; order is a column, never implied."""

SAMPLES = "song_id string, chunk_no int, samples array<float>"
SPECTROGRAM = "song_id string, t int, f int, value float"
PEAKS = "song_id string, f int, t int"
FINGERPRINTS = "song_id string, hash int, t1 int"
SEGMENTS = "song_id string, seg_no int, ref_start double, ref_end double, ep_start double, ep_end double, offset double, support int"
EMISSIONS = "song_id string, frame int, lp array<float>"
VOCABULARY = "kana string, token_id int"
UNITS = "song_id string, line_no int, unit_no int, text string, start double, end double, conf double, smear_fixed boolean"
LYRIC_ROWS = "song_id string, line_no int, surface string, reading string"
WORDS = "song_id string, line_no int, word_no int, surface string, kana string"
CELLS = "song_id string, line_no int, unit_no int, unit string, owner int, cell string"
EVENTS = "path string, event_no int, start double, end double, text string, style string, comment boolean, layer int, name string, margin_l string, margin_r string, margin_v string, effect string"
TIMINGS = "song_id string, t double, text string"
THEMES = "ord int, kind string, sequence string, title string, artist string, episodes string, source string, series string, year int"
HITS = "song_id string, ord int, trackName string, artistName string, duration double, syncedLyrics string, plainLyrics string, instrumental boolean"
CANDIDATES = "ord int, ident string, title string, uploader string, duration double"
LEXICON = "surface string, reading string, base string, pos string, common int, ord int, uk int, conj int, form string"
PARSES = "surface string, kana string, readings array<string>"
DECISIONS = "key string, stage string, surface string, chosen string, confidence string"
BASELINE = "line int, surface string, reading string"
READINGS = "line int, flag string, surface string, reading string"
PROJECTS = "schema_version int, title string, artist string, audio string, video string, source string, offset double, start double, duration double, segments array<struct<ref_start:double,ref_end:double,ep_start:double,ep_end:double,offset:double,support:int>>"

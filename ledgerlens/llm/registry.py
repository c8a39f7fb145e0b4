"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op3_byte_bpe
from .chat import op7_chat
from .decontaminate import op9_decontaminate
from .languages import op13_languages
from .licenses import op10_licenses
from .lines import op5_lines
from .neighbours import op2_neighbours
from .quality import op1_quality
from .simhash import op4_simhash
from .suffixes import op8_suffixes
from .whitening import op12_whitening
from .windows import SQL as WINDOWS_SQL
from .windows import op6_windows

QUERIES = {f.__name__: f for f in (op1_quality, op2_neighbours, op3_byte_bpe, op4_simhash, op5_lines, op6_windows, op7_chat, op8_suffixes, op9_decontaminate, op10_licenses, op11_alignment, op12_whitening, op13_languages)}
ORACLE_SQL: dict[str, str] = {"op6_windows": WINDOWS_SQL}

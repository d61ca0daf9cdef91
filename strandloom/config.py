"""Settings of an analysis, with the defaults that results are comparable under."""

from __future__ import annotations

from dataclasses import dataclass

#: Reads are used above this mapping quality and with one of these flags.
MIN_MAPQ = 39
FLAGS = (0, 16, 83, 99, 147, 163)
#: Log-likelihoods of a call that is taken as certain: of the wrong and of the right state.
LOG_WRONG, LOG_RIGHT = -50.0, 0.0
#: Bounds of the parameters a, b, c.
BOX = (20.0, 150.0, 50.0)
#: Permutations from which on a random draw replaces enumeration.
LMAX = 1000


@dataclass(frozen=True)
class Config:
    min_cov: float = 10.0
    min_perc_obs: float = 0.66
    min_sites: int = 10
    min_grp_dist: int = 10
    max_size_subreg: int = 350
    size_est_reg: int = 3000
    max_em_init: int = 10
    max_em_iters: int = 20
    out_dir: str = "./"
    out_prefix: str = "strandloom"
    mod_nse: bool = True
    informme_mode: bool = False
    matched: bool = False
    caller: str = "nanopolish"
    trim: tuple[int, int, int, int] = (0, 0, 0, 0)
    pe: bool = False
    lmax_two_samp: int = 100
    perm_blocks: int = 8
    pval_comp: bool = True
    seed: int = 17
